"""Annotation study over the text tables: which documents to have labelled, and what their labels would show.

For every share of the documents that a source may have labelled, the worklist holds those
whose predictions stand highest by consensus of the model families (no label is read for
that). The report holds, for every source and family, the metrics that the labels of the
worklist would give, beside those of all labels, and how far the former are off.

    python -m jobs.annotation_study --tables DIR --out DIR [--config FILE]

``DIR/worklist`` and ``DIR/report`` are partitioned by ``fraction``. A rerun over the same
tables overwrites each partition with the same rows; one over other fractions leaves the
partitions of the earlier ones.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from jobs.common import HERE, LOG, configured, main
from labelscope.operators import observe
from labelscope.plans import tables as T

CONFIG = os.path.join(HERE, "annotation_study.json")
DEFAULTS = {"fractions": list(observe.FRACTIONS), "seed": observe.GLOBAL_SEED}
MEASURES = ("balanced_accuracy", "macro_f1", "brier", "log_loss")


def report(masks: DataFrame, predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """(participant_id, model_family, fraction, counts, observed and full measures, their differences)."""
    rows = observe.labelled(predictions, labels)
    counts = observe.label_yield(masks, labels, ["fraction"]).select(
        "participant_id", "fraction", "selected_count", "eligible_selected_count", "baseline_selected_count", "stress_selected_count", "ba_estimable"
    )
    seen = observe.observed_metrics(masks, rows, ["fraction"]).select("participant_id", "fraction", "model_family", *MEASURES)
    full = observe.full_metrics(rows).select("participant_id", "model_family", *[F.col(m).alias(f"full_{m}") for m in MEASURES])
    every = counts.join(predictions.select("participant_id", "model_family").distinct(), "participant_id")
    joined = every.join(seen, ["participant_id", "fraction", "model_family"], "left").join(full, ["participant_id", "model_family"], "left")
    return joined.select("*", *[(F.col(m) - F.col(f"full_{m}")).alias(f"off_{m}") for m in MEASURES])


def run(spark: SparkSession, tables: str, out: str, config: str = CONFIG) -> None:
    """Read ``documents`` and ``labels`` below ``tables``; write ``worklist`` and ``report`` below ``out``.

    Documents without a known label count as selected and not as eligible; sources without
    labels have null measures; empty tables give empty outputs. Texts are not read.
    """
    settings = configured(spark, config, DEFAULTS)
    predictions = T.scores(spark, tables).drop("doc_id")
    known = T.windows(spark, tables).select("participant_id", "window_id", "y")
    LOG.info("read documents and labels below %s, settings %s", tables, settings)
    masks = observe.targeted_mask(predictions, tuple(settings["fractions"]), settings["seed"])
    worklist = masks.join(known, ["participant_id", "window_id"]).select("participant_id", "window_id", F.col("y").isNotNull().alias("labelled"), "fraction")
    for name, table in (("worklist", worklist), ("report", report(masks, predictions, known))):
        table.repartition("fraction", "participant_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fraction").parquet(f"{out}/{name}")
        written = read_back(spark, out, name)
        LOG.info("wrote %s/%s: %s", out, name, {r["fraction"]: r["count"] for r in written.groupBy("fraction").count().collect()})


def read_back(spark: SparkSession, out: str, name: str) -> DataFrame:
    """An output table, its partition column as the text it was written from."""
    found = spark.read.parquet(f"{out}/{name}").schema
    return spark.read.schema(StructType([StructField(f.name, StringType() if f.name == "fraction" else f.dataType) for f in found])).parquet(f"{out}/{name}")


if __name__ == "__main__":
    main("annotation study", {"tables": "folder with documents.parquet and labels.parquet", "out": "folder to write to"}, CONFIG, run)
