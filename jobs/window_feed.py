"""Window feed: labelled windows of event recordings, kept up to date as event files arrive.

    python -m jobs.window_feed --events DIR --out DIR --checkpoint DIR [--config FILE]

A file stream with a checkpoint takes the files that are new. Each micro-batch is reduced to
one row for each participant, window and code, written as ``partials/batch=N``; a batch that
is run again after a failure overwrites its own folder. Then the periods that batches
beyond the mark have touched are put together anew from the partial rows and written to
``windows``, partitioned by ``period``, by dynamic overwrite, and the mark moves on. A run that
dies anywhere is made good by the next one, and a run without new files changes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import HERE, LOG, configured, main, read_if_there
from labelscope.functions import scalars as S
from labelscope.operators.windows import WindowSpec, window_of
from labelscope.plans.tables import as_samples

CONFIG = os.path.join(HERE, "window_feed.json")
DEFAULTS = {"window_seconds": 432_000.0, "windows_per_period": 2, "files_per_batch": 1000}
PARTIALS = "participant_id string, window_index int, code int, n long, n_values long, total double, squares double, least double, most double, first_sample long, last_sample long, batch int, period int"
MARK = "batch int"


def partial_rows(events: DataFrame, spec: WindowSpec, windows_per_period: int) -> DataFrame:
    """One row for each participant, window and code of ``events``; sums that later rows can be added to.

    Events without user or time, and those before the recordings' origin, are in no window.
    """
    samples = as_samples(events).filter("participant_id IS NOT NULL AND sample_index >= 0").withColumn("window_index", window_of(F.col("sample_index"), 1.0, spec))
    value = S.present(F.col("value"))
    summed = samples.groupBy("participant_id", "window_index", "code").agg(
        F.count("*").alias("n"), F.count(value).alias("n_values"), F.sum(value).alias("total"), F.sum(value * value).alias("squares"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.min("sample_index").alias("first_sample"), F.max("sample_index").alias("last_sample"),
    )
    return summed.withColumn("period", F.floor(F.col("window_index") / windows_per_period).cast("int"))


def window_rows(partials: DataFrame) -> DataFrame:
    """One row a window: its label as far as it has one code, and statistics of its values, from partial rows."""
    both = partials.groupBy("period", "participant_id", "window_index").agg(
        F.sum("n").alias("n_samples"), F.sum("n_values").alias("n_values"), F.collect_set("code").alias("codes"), F.count_if(F.col("code").isNull()).alias("uncoded"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        F.min("least").alias("min_value"), F.max("most").alias("max_value"), F.min("first_sample").alias("first_sample"), F.max("last_sample").alias("last_sample"),
    )
    code = F.when((F.size("codes") == 1) & (F.col("uncoded") == 0), F.element_at("codes", 1)).cast("short")
    mean = F.try_divide("total", "n_values")
    return both.withColumn("code", code).select(
        "participant_id", "window_index", S.window_id(F.lit("events"), F.col("participant_id"), F.col("window_index")).alias("window_id"), "n_samples",
        S.codes_text(F.col("codes")).alias("raw_label_codes_present"), S.condition_name(F.col("code")).alias("condition_name"), S.ineligibility(F.col("code")).alias("ineligibility_reason"),
        mean.alias("mean_value"), F.when(mean.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.try_divide("squares", "n_values") - mean * mean))).alias("std_value"), "min_value", "max_value", "first_sample", "last_sample", "period",
    )


def take_new(spark: SparkSession, events: str, out: str, checkpoint: str, settings: dict) -> None:
    """Every file below ``events`` that the checkpoint has not seen, as partial rows."""
    spec = WindowSpec(float(settings["window_seconds"]))

    def batch(rows: DataFrame, number: int) -> None:
        made = partial_rows(rows, spec, settings["windows_per_period"])
        made.write.mode("overwrite").partitionBy("period").parquet(f"{out}/partials/batch={number}")
        LOG.info("batch %s: wrote %s/partials/batch=%s", number, out, number)

    stream = spark.readStream.schema(spark.read.parquet(events).schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(events)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def bring_up_to_date(spark: SparkSession, out: str) -> None:
    """Write the periods anew that batches beyond the mark have touched, then move the mark."""
    partials, mark = read_if_there(spark, f"{out}/partials", PARTIALS), read_if_there(spark, f"{out}/mark", MARK).agg(F.max("batch")).first()[0]
    new = partials if mark is None else partials.filter(F.col("batch") > mark)
    last = new.agg(F.max("batch")).first()[0]
    if last is None:
        LOG.info("no new events; %s/windows stays", out)
        return
    touched = partials.join(new.select("period").distinct(), "period", "left_semi")
    window_rows(touched).repartition("period", "participant_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(f"{out}/windows")
    LOG.info("wrote %s/windows, periods of batches %s to %s; read %s partial rows", out, -1 if mark is None else mark, last, touched.count())
    spark.createDataFrame([(last,)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{out}/mark")


def run(spark: SparkSession, events: str, out: str, checkpoint: str, config: str = CONFIG) -> None:
    """Take what is new below ``events`` (a folder, or a pattern of files or folders) and bring ``out/windows`` up to date.

    The configuration has to stay that of the first run into ``out``. Repeated events count each
    time; a window's values that are null or not
    finite count as samples alone.
    """
    settings = configured(spark, config, DEFAULTS)
    LOG.info("reading new files below %s, settings %s", events, settings)
    take_new(spark, events, out, checkpoint, settings)
    bring_up_to_date(spark, out)


if __name__ == "__main__":
    main("window feed", {"events": "folder of event files, or a pattern", "out": "folder to write to", "checkpoint": "folder of the stream's checkpoint"}, CONFIG, run)
