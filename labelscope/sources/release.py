"""A raw release of recordings: what is there, schedules, headers, archives, verified loading."""

from __future__ import annotations

import io
import pickle
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.functions import scalars as S
from labelscope.sources import integrity

#: Files a participant should have ({p} is the id), conditions of the schedule and their codes.
EXPECTED = ("{p}.pkl", "{p}_quest.csv", "{p}_readme.txt", "{p}_respiban.txt", "{p}_E4_Data.zip")
SCHEDULE_CODES = {"Base": 1, "TSST": 2, "Fun": 3, "Medi 1": 4, "Medi 2": 4}
SCHEDULE_IGNORED = ("bRead", "sRead", "fRead")


class ReleaseError(RuntimeError):
    """A release is not what its baseline or format says."""


def participants(paths: DataFrame) -> DataFrame:
    """participant_id of the folders S<number> in ``paths`` (path relative to the release), in order of the number."""
    folder = F.split_part("path", F.lit("/"), F.lit(1)).alias("participant_id")
    found = paths.filter(F.instr("path", "/") > 0).select(folder).distinct().filter(F.col("participant_id").rlike(r"^S\d+$"))
    return found.orderBy(S.participant_number(F.col("participant_id")))


def expected_files(paths: DataFrame, templates: tuple[str, ...] = EXPECTED) -> DataFrame:
    """(participant_id, file, present) for every participant and expected file."""
    each = participants(paths).withColumn("_t", F.explode(F.array(*[F.lit(t) for t in templates])))
    named = each.select("participant_id", F.replace(F.col("_t"), F.lit("{p}"), F.col("participant_id")).alias("file"))
    named = named.withColumn("path", F.concat_ws("/", "participant_id", "file"))
    return named.join(paths.select("path", F.lit(True).alias("_p")), "path", "left").select("participant_id", "file", F.coalesce("_p", F.lit(False)).alias("present"))


def parse_schedule(lines: DataFrame, codes: dict[str, int] = SCHEDULE_CODES, ignored: tuple[str, ...] = SCHEDULE_IGNORED) -> DataFrame:
    """(participant_id, position, condition, expected_code, start_s, end_s) from (participant_id, value) lines.

    The ORDER, START and END rows are split at ``;`` and zipped. Rows of unequal length and
    unknown conditions are errors; ignored conditions are left out.
    """
    rows = lines.withColumn("_k", F.regexp_extract("value", r"^#\s*(ORDER|START|END)\b", 1)).filter("_k <> ''")
    each = F.split("value", ";")
    cells = F.filter(F.transform(F.slice(each, 2, F.size(each)), lambda x: F.trim(x)), lambda x: x != "")
    wide = rows.groupBy("participant_id").agg(*[F.max(F.when(F.col("_k") == k, cells)).alias(k) for k in ("ORDER", "START", "END")])
    same = (F.size("ORDER") == F.size("START")) & (F.size("START") == F.size("END"))
    zipped = F.when(same, F.arrays_zip("ORDER", "START", "END")).otherwise(F.raise_error(F.lit("schedule rows differ in length")))
    each = wide.select("participant_id", F.posexplode(zipped).alias("position", "x")).select("participant_id", "position", F.col("x.ORDER").alias("condition"), "x.START", "x.END")
    kept = each.filter(~F.col("condition").isin(*ignored))
    known = F.create_map(*[v for k, c in codes.items() for v in (F.lit(k), F.lit(c))])
    code = F.coalesce(F.try_element_at(known, F.col("condition")), F.raise_error(F.concat(F.lit("unknown condition "), "condition")).cast("int"))
    return kept.select("participant_id", "position", "condition", code.alias("expected_code"), S.minutes_seconds(F.col("START")).alias("start_s"), S.minutes_seconds(F.col("END")).alias("end_s"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(participant_id, value, line): lines of text files in participant folders, numbered from 1."""
    whole = spark.read.text(path, wholetext=True).select(F.split_part(F.input_file_name(), F.lit("/"), F.lit(-2)).alias("participant_id"), F.col("value").alias("_t"))
    return whole.select("participant_id", F.posexplode(F.split("_t", r"\r?\n")).alias("_n", "value")).select("participant_id", "value", (F.col("_n") + 1).alias("line"))


def parse_header(lines: DataFrame) -> DataFrame:
    """(participant_id, header json, n_rows, header_ended) of text recordings: JSON in line 2, data after ``# EndOfHeader``."""
    end = F.min(F.when(F.col("value").startswith("# EndOfHeader"), F.col("line")))
    text = F.max(F.when(F.col("line") == 2, F.regexp_replace("value", r"^#\s*", "")))
    data = F.count_if(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return lines.groupBy("participant_id").agg(text.alias("header"), data.alias("n_rows"), end.isNotNull().alias("header_ended"))


def numeric_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Numbers separated by any white space, as doubles; lines that start with # are comments, empty ones are none."""
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("_t"))
    cells = F.split(F.col("_t"), " ")
    return rows.filter("_t <> '' AND NOT startswith(_t, '#')").select(*[F.get(cells, i).cast("double").alias(n) for i, n in enumerate(names)])


def notes_after(text, marker: str):
    """Free text after a marker, trimmed; null where the marker is missing."""
    return F.when(F.instr(text, marker) > 0, F.trim(F.substring_index(text, marker, -1)))


def archive_streams(files: DataFrame) -> DataFrame:
    """(path, member, start_unix, rate_hz, n_rows, duration_s) of CSV members in zip files (path, content).

    First line: start time, second line: rate, then rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in sorted(m for m in archive.namelist() if m.endswith(".csv")):
                        with archive.open(member) as file:
                            start, rate = (float(file.readline().split(b",")[0]) for _ in range(2))
                            n = sum(1 for line in file if line.strip())
                        out.append((path, member, start, rate, n, n / rate))
            yield pd.DataFrame(out, columns=["path", "member", "start_unix", "rate_hz", "n_rows", "duration_s"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, start_unix double, rate_hz double, n_rows long, duration_s double")


@dataclass(frozen=True)
class VerifiedRelease:
    """A release whose files were all compared with a checksum baseline. Made by ``open`` alone."""

    root: Path
    expected: dict[str, str]
    _sealed: object = None

    def __post_init__(self) -> None:
        if self._sealed is not _SEAL:
            raise ReleaseError("use VerifiedRelease.open")

    @classmethod
    def open(cls, spark: SparkSession, root: Path, baseline: Path) -> VerifiedRelease:
        if not Path(baseline).exists():
            raise ReleaseError(f"no baseline {baseline}")
        changes = integrity.changes_since(spark, str(root), baseline)
        if changes:
            raise ReleaseError(f"release differs from its baseline: {changes}")
        return cls(Path(root), {r["path"]: r["sha256"] for r in integrity.read_baseline(spark, baseline).collect()}, _SEAL)

    @property
    def n_files(self) -> int:
        return len(self.expected)

    def verified_path(self, relative: str) -> Path:
        """A file of the release, hashed again just before it is used."""
        path = (self.root / relative).resolve()
        if relative not in self.expected or not path.is_relative_to(self.root.resolve()):
            raise ReleaseError(f"{relative} is not part of the release")
        with path.open("rb") as file:
            digest = integrity.digest_of(file)
        if digest != self.expected[relative]:
            raise ReleaseError(f"{relative} changed since it was verified")
        return path


_SEAL = object()

WRIST = {"ACC": 32.0, "BVP": 64.0, "EDA": 4.0, "TEMP": 4.0}
LABEL_RATE = 700.0
CHEST = dict.fromkeys(("ACC", "ECG", "EMG", "EDA", "Temp", "Resp"), LABEL_RATE)


def validate_recording(data: object, participant: str, spread_s: float = 1.0) -> dict[str, np.ndarray]:
    """Wrist signals, chest signals (as ``chest.<name>``, where there are any) and label of a loaded recording.

    Raises ``ReleaseError`` at the first fault. Chest signals have a row for each label.
    """
    if not isinstance(data, dict) or not {"signal", "label", "subject"} <= set(data):
        raise ReleaseError("keys are missing")
    if data["subject"] != participant:
        raise ReleaseError(f"recording is of {data['subject']}, not {participant}")
    out: dict[str, np.ndarray] = {}
    chest = data["signal"].get("chest", {})
    wanted = [(name, name, data["signal"].get("wrist", {})) for name in WRIST] + [(f"chest.{name}", name, chest) for name in CHEST if chest]
    for key, name, signals in wanted:
        x = np.asarray(signals.get(name))
        if x.dtype.kind not in "iuf":
            raise ReleaseError(f"{key} is not numeric")
        x = x[:, None] if x.ndim == 1 else x
        if x.ndim != 2 or x.shape[1] != (3 if name == "ACC" else 1):
            raise ReleaseError(f"{key} has shape {x.shape}")
        if not len(x) or not np.isfinite(x).all():
            raise ReleaseError(f"{key} is empty or not finite")
        out[key] = x.astype(float)
    label = np.asarray(data["label"])
    label = label[:, 0] if label.ndim == 2 and label.shape[1] == 1 else label
    if label.ndim != 1 or label.dtype.kind not in "iuf" or (label != np.rint(label)).any():
        raise ReleaseError("label is not a vector of whole numbers")
    if not set(np.unique(label).astype(int)) <= set(S.CONDITIONS):
        raise ReleaseError("label has undocumented codes")
    if odd := [f"chest.{n}" for n in CHEST if chest and len(out[f"chest.{n}"]) != len(label)]:
        raise ReleaseError(f"{odd} have not a row for each label")
    seconds = [len(out[n]) / r for n, r in WRIST.items()] + [len(label) / LABEL_RATE]
    if max(seconds) - min(seconds) > spread_s:
        raise ReleaseError(f"durations differ by {max(seconds) - min(seconds):.3f} s")
    return out | {"label": label.astype(np.int16)}


def load_recording(release: VerifiedRelease, participant: str) -> dict[str, np.ndarray]:
    """A participant's arrays, read-only; the pickle is opened only after its hash was verified."""
    path = release.verified_path(f"{participant}/{participant}.pkl")
    with path.open("rb") as file:
        data = pickle.load(file, encoding="latin1")
    out = validate_recording(data, participant)
    for x in out.values():
        x.setflags(write=False)
    return out


def chest_table(spark: SparkSession, participant: str, arrays: dict[str, np.ndarray]) -> DataFrame | None:
    """A row for each label with the chest signals; none where the recording has no chest device."""
    if "chest.ECG" not in arrays:
        return None
    table = pd.DataFrame({"participant_id": participant, "sample_index": np.arange(len(arrays["label"]))})
    for name in CHEST:
        x = arrays[f"chest.{name}"]
        for i, axis in enumerate(("_x", "_y", "_z") if x.shape[1] == 3 else ("",)):
            table[f"{name.lower()}{axis}"] = x[:, i]
    return spark.createDataFrame(table)


def recording_tables(spark: SparkSession, participant: str, arrays: dict[str, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Long tables (wrist samples, labels) of one recording, to be written as Parquet: the one-off conversion.

    One recording fits the driver by the source's own format (a pickle is read whole).
    """
    parts = []
    for name, rate in WRIST.items():
        x = arrays[name]
        part = pd.DataFrame({"participant_id": participant, "modality": name, "sample_index": np.arange(len(x)), "rate_hz": rate})
        part["value"] = x[:, 0] if x.shape[1] == 1 else np.nan
        for i, axis in enumerate("xyz"):
            part[axis] = x[:, i] if x.shape[1] == 3 else np.nan
        parts.append(part)
    label = pd.DataFrame({"participant_id": participant, "sample_index": np.arange(len(arrays["label"])), "code": arrays["label"]})
    samples = spark.createDataFrame(pd.concat(parts))
    return samples.withColumns({c: S.present(F.col(c)) for c in ("value", "x", "y", "z")}), spark.createDataFrame(label)
