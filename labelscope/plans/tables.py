"""The driver's tables in the shape of recordings, labels and predictions, as DataFrames and as SQL.

Users are participants, their events samples (one second is one sample) whose type stands
for a label code; documents are windows, their sources participants, ``labels.quality`` the
partly known reference, and three deterministic scores the learned families.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
CODES = {"error": 0, "view": 1, "signup": 2, "click": 3, "purchase": 4}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_samples(e: DataFrame) -> DataFrame:
    """participant_id, event_id, t_us, sample_index, code, value, x, y, z of events, a stream of them too."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    code = F.lit(None).cast("int")
    for name, number in CODES.items():
        code = F.when(F.col("event_type") == name, F.lit(number)).otherwise(code)
    e = e.withColumn("t_us", t).withColumn("sample_index", F.floor(F.col("t_us") / 1_000_000).cast("long"))
    return e.select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("participant_id"), "event_id", "t_us", "sample_index", code.alias("code"), "value",
        F.col("value").alias("x"), (F.col("event_id") % 128 - 64).cast("double").alias("y"), ((F.col("user_id") * 37 + F.col("sample_index")) % 128 - 64).cast("double").alias("z"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(read(spark, sf_dir, "events"))


SAMPLES = """samples AS (
  SELECT 'S' || user_id AS participant_id, event_id, epoch_us(ts) - 1704067200000000 AS t_us, CAST(floor((epoch_us(ts) - 1704067200000000) / 1000000) AS BIGINT) AS sample_index,
         CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS code, value,
         value AS x, CAST(event_id % 128 - 64 AS DOUBLE) AS y,
         CAST((user_id * 37 + CAST(floor((epoch_us(ts) - 1704067200000000) / 1000000) AS BIGINT)) % 128 - 64 AS DOUBLE) AS z
  FROM events)"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("participant_id").agg((F.max("sample_index") + 1).cast("double").alias("duration_s"))


RECORDINGS = "recordings AS (SELECT participant_id, CAST(max(sample_index) + 1 AS DOUBLE) AS duration_s FROM samples GROUP BY participant_id)"

#: Multipliers and modulus; the modulus less one is prime, so that no mean lies halfway between rounded values.
FAMILY_SCORES = {"logistic": (7919, 1, 104), "random_forest": (104_729, 3, 98), "xgboost": (1_299_709, 7, 90)}
MAJORITY = 0.85


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant_id, window_id, doc_id, n_chars, y (null where the reference is unknown)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    known = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y"))
    who = F.concat(F.lit("S"), F.substring("source", 4, 20))
    return d.join(known, "doc_id", "left").select(who.alias("participant_id"), F.format_string("documents:%s:w%05d", who, F.col("doc_id")).alias("window_id"), "doc_id", "n_chars", "y")


WINDOWS = """windows AS (
  SELECT 'S' || substr(source, 4) AS participant_id, 'documents:S' || substr(source, 4) || ':w' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(5, len(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS window_id,
         doc_id, n_chars, CAST(quality AS INTEGER) AS y
  FROM documents LEFT JOIN labels USING (doc_id))"""


def _score(a: int, b: int, m: int) -> Column:
    return ((F.col("doc_id") * a + F.col("n_chars") * b) % m) / F.lit(float(m - 1))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant_id, window_id, model_family, prob_positive, hard, without any label: what masks are made from."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    who = F.concat(F.lit("S"), F.substring("source", 4, 20))
    made = [F.struct(F.lit(f).alias("model_family"), _score(*k).alias("prob_positive")) for f, k in FAMILY_SCORES.items()]
    every = F.array(*made, F.struct(F.lit("majority").alias("model_family"), F.lit(MAJORITY).alias("prob_positive")))
    wide = d.select("doc_id", who.alias("participant_id"), F.format_string("documents:%s:w%05d", who, F.col("doc_id")).alias("window_id"), F.explode(every).alias("_f"))
    return wide.select("doc_id", "participant_id", "window_id", "_f.model_family", "_f.prob_positive", (F.col("_f.prob_positive") >= 0.5).cast("byte").alias("hard"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant_id, window_id, model_family, prob_positive, hard, y."""
    known = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("y"))
    return scores(spark, sf_dir).join(known, "doc_id", "left").drop("doc_id")


PREDICTIONS = (
    WINDOWS
    + """, predictions AS (
  SELECT participant_id, window_id, f.model_family, f.p AS prob_positive, CASE WHEN f.p >= 0.5 THEN 1 ELSE 0 END AS hard, y
  FROM (SELECT *, unnest(["""
    + ", ".join(f"{{'model_family': '{f}', 'p': CAST((doc_id * {a} + n_chars * {b}) % {m} AS DOUBLE) / {m - 1}}}" for f, (a, b, m) in FAMILY_SCORES.items())
    + f", {{'model_family': 'majority', 'p': CAST({MAJORITY} AS DOUBLE)}}]) AS f FROM windows))"
)
