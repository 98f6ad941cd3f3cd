"""Declared columns with roles, and the contracts checked against them.

A column is declared as Spark's own StructField, whose metadata carry role, modality and unit;
only columns of role ``feature`` may be seen by a model. A mismatch is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VERSION = "1.1.0"
MODALITIES = ("acc", "eda", "bvp", "temp")
_TYPES = {
    "float64": T.DoubleType(), "int64": T.LongType(), "int32": T.IntegerType(), "int16": T.ShortType(), "int8": T.ByteType(), "bool": T.BooleanType(), "string": T.StringType(),
}


class ContractError(RuntimeError):
    """A table, document or configuration is not what was declared."""


def declared(name: str, role: str, modality: str, kind: str = "float64", unit: str = "", required: bool = False, provisional: bool = False) -> T.StructField:
    """A column as Spark's own field; its metadata carry what a type does not say."""
    return T.StructField(name, _TYPES[kind], not required, {"role": role, "modality": modality, "kind": kind, "unit": unit, "provisional": provisional})


def allowed(field: T.StructField) -> bool:
    """Whether a model may see the column."""
    return field.metadata["role"] == "feature" and not field.metadata["provisional"]


def described(field: T.StructField) -> dict:
    """The entry of a column in a schema document."""
    said = field.metadata
    return {"name": field.name, "role": said["role"], "modality": said["modality"], "dtype": said["kind"], "unit": said["unit"], "nullable": field.nullable, "definition": "", "provisional": said["provisional"]}


def _summary(prefix: str, modality: str, names: str, unit: str) -> list[T.StructField]:
    return [declared(f"{prefix}_{n}", "feature", modality, unit=f"{unit}/s" if n == "slope" else unit) for n in names.split()]


def feature_columns() -> list[T.StructField]:
    """The 67 numeric columns in table order; pulse-derived ones are provisional."""
    acc = [c for a in "xyz" for c in _summary(f"acc_{a}", "acc", "mean std min max range", "g")]
    acc += _summary("acc_mag", "acc", "mean std median iqr min max range rms p10 p90 diff_mean_abs diff_std", "g")
    eda = _summary("eda", "eda", "mean median std min max range iqr slope", "uS") + _summary("eda_tonic", "eda", "mean std slope", "uS")
    eda += _summary("eda_phasic", "eda", "mean std", "uS") + [declared("eda_scr_count", "feature", "eda", unit="count")] + _summary("eda_scr_amp", "eda", "sum mean max", "uS")
    bvp = _summary("bvp", "bvp", "mean std median iqr min max range", "")
    pulse = [("bvp_beat_count", "count"), ("bvp_valid_ibi_count", "count"), ("bvp_beat_coverage", "share"), *((f"hr_{n}", "bpm") for n in "mean median std min max".split())]
    bvp += [declared(n, "feature", "bvp", unit=u, provisional=True) for n, u in pulse]
    return acc + eda + bvp + _summary("temp", "temp", "mean median std min max range iqr slope", "degC")


def provenance_columns() -> list[T.StructField]:
    text = [declared(n, "provenance", "", "string", required=True) for n in ("dataset", "participant_id", "window_id")]
    time = [declared("window_index", "provenance", "", "int32", required=True)] + [declared(n, "provenance", "", "float64", "s", True) for n in ("start_seconds", "end_seconds")]
    edges = [declared(f"{m}_{e}_sample", "provenance", m if m != "label" else "", "int64", required=True) for m in ("label", *MODALITIES) for e in ("start", "end")]
    return text + time + edges + [declared(n, "provenance", "", "string", required=True) for n in ("source_file", "source_sha256")]


def reference_columns() -> list[T.StructField]:
    kinds = (
        ("raw_label_codes_present", "string"), ("n_label_samples", "int64"), ("is_label_homogeneous", "bool"), ("homogeneous_raw_label", "int16"),
        ("condition_name", "string"), ("binary_eligible", "bool"), ("analysis_label", "int8"), ("ineligibility_reason", "string"),
    )
    return [declared(n, "reference", "", k) for n, k in kinds]


def quality_columns() -> list[T.StructField]:
    each = (("n_samples", "int64"), ("count_ok", "bool"), ("finite_fraction", "float64"), ("constant", "bool"))
    own = [declared(f"q_{m}_{n}", "quality", m, k) for m in MODALITIES for n, k in each]
    flags = ("q_acc_near_rail", "q_eda_below_plausible", "q_temp_out_of_range", "q_eda_decomposition_ok", "q_bvp_pulse_detection_ok", "q_bvp_hr_available")
    named = [declared(n, "quality", n.split("_")[1], "bool") for n in flags]
    return own + named + [declared("q_feature_error", "quality", "", "string"), declared("q_structural_ok", "quality", "", "bool")]


def all_columns() -> list[T.StructField]:
    """The 117 columns of the feature table, in order."""
    return provenance_columns() + reference_columns() + quality_columns() + feature_columns()


def struct(columns: Iterable[T.StructField]) -> T.StructType:
    return T.StructType(list(columns))


def document(columns: list[T.StructField], parameters: dict) -> dict:
    """The schema as a document to be written beside a table."""
    return {
        "schema_version": VERSION, "n_columns": len(columns), "columns": [described(c) for c in columns],
        "model_feature_columns": [c.name for c in columns if allowed(c)], "parameters": parameters,
    }


def model_features(schema: dict) -> list[str]:
    """The allowlist of a schema document; its own list must agree with the roles."""
    listed = schema["model_feature_columns"]
    by_role = [c["name"] for c in schema["columns"] if c["role"] == "feature" and not c.get("provisional", False)]
    if len(set(listed)) != len(listed):
        raise ContractError("model feature list has duplicates")
    if listed != by_role:
        raise ContractError("model feature list differs from the columns' roles")
    return listed


def select_model_features(table: DataFrame, schema: dict, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keys and allowlisted columns in declared order; fails on missing or unknown columns and wrong types."""
    names = [c["name"] for c in schema["columns"]]
    if set(table.columns) != set(names):
        raise ContractError(f"columns differ: missing {sorted(set(names) - set(table.columns))}, unknown {sorted(set(table.columns) - set(names))}")
    wanted = model_features(schema)
    kinds = dict(table.dtypes)
    if wrong := [c for c in wanted if kinds[c] not in ("double", "float", "bigint", "int")]:
        raise ContractError(f"not numeric: {wrong}")
    return table.select(*keys, *wanted)


def order_columns(table: DataFrame, columns: list[T.StructField]) -> DataFrame:
    """``table`` in declared order; its set of columns must be exactly the declared one."""
    names = [c.name for c in columns]
    if set(table.columns) != set(names) or len(table.columns) != len(names):
        raise ContractError(f"columns differ from the declared ones by {sorted(set(table.columns) ^ set(names))}")
    return table.select(*names)


def dumps(schema: dict) -> str:
    return json.dumps(schema, indent=1, sort_keys=True)
