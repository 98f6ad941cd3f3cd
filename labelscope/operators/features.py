"""Feature aggregates of windows. One grouped pass for each modality; spreads are population ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions import scalars as S


def quantiles(value: Column, *q: float) -> Column:
    """Exact quantiles with linear interpolation, in one pass for all."""
    return F.percentile(value, F.array(*[F.lit(float(x)) for x in q]))


def iqr(value: Column) -> Column:
    q = quantiles(value, 0.25, 0.75)
    return q[1] - q[0]


def slope(value: Column, seconds: Column) -> Column:
    """Least-squares slope; null with fewer than two distinct times."""
    return F.regr_slope(value, seconds)


def summary(value: Column, prefix: str, *names: str, seconds: Column | None = None) -> list[Column]:
    """Aliased aggregates of the finite values: mean, std, median, iqr, min, max, range, rms, p10, p90, slope."""
    v = S.present(value)
    known = {
        "mean": lambda: F.avg(v), "std": lambda: F.stddev_pop(v), "median": lambda: F.percentile(v, F.lit(0.5)), "iqr": lambda: iqr(v),
        "min": lambda: F.min(v), "max": lambda: F.max(v), "range": lambda: F.max(v) - F.min(v), "rms": lambda: F.sqrt(F.avg(v * v)),
        "p10": lambda: F.percentile(v, F.lit(0.1)), "p90": lambda: F.percentile(v, F.lit(0.9)), "slope": lambda: slope(v, seconds),
    }
    return [known[n]().alias(f"{prefix}_{n}") for n in names]


def difference(samples: DataFrame, by: list[str], order: list[str], value: str, out: str = "diff") -> DataFrame:
    """First difference inside each group, in order; null at a group's first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    return samples.withColumn(out, F.col(value) - F.lag(value).over(w))


def acceleration_features(samples: DataFrame, by: list[str], order: str = "sample_index") -> DataFrame:
    """The 27 accelerometer features from counts x, y, z."""
    g = samples.select(*by, order, *[S.acceleration(F.col(a)).alias(a) for a in "xyz"])
    g = g.withColumn("mag", S.magnitude(F.col("x"), F.col("y"), F.col("z")))
    g = difference(g, by, [order], "mag")
    axes = [c for a in "xyz" for c in summary(F.col(a), f"acc_{a}", "mean", "std", "min", "max", "range")]
    mag = summary(F.col("mag"), "acc_mag", "mean", "std", "median", "iqr", "min", "max", "range", "rms", "p10", "p90")
    moves = [F.avg(F.abs("diff")).alias("acc_mag_diff_mean_abs"), F.stddev_pop("diff").alias("acc_mag_diff_std")]
    return g.groupBy(*by).agg(*axes, *mag, *moves)


def eda_features(samples: DataFrame, by: list[str]) -> DataFrame:
    """Raw, tonic and phasic features from value, tonic, phasic (null where decomposition failed) and t seconds."""
    t = F.col("t")
    return samples.groupBy(*by).agg(
        *summary(F.col("value"), "eda", "mean", "median", "std", "min", "max", "range", "iqr", "slope", seconds=t),
        *summary(F.col("tonic"), "eda_tonic", "mean", "std", "slope", seconds=t), *summary(F.col("phasic"), "eda_phasic", "mean", "std"),
    )


def event_features(windows: DataFrame, events: DataFrame, by: list[str], amplitude: str, prefix: str) -> DataFrame:
    """Count and sum (0 without events), mean and max (null without) of events in every window."""
    got = events.groupBy(*by).agg(
        F.count(amplitude).alias("_n"), F.sum(amplitude).alias("_s"), F.avg(amplitude).alias(f"{prefix}_amp_mean"), F.max(amplitude).alias(f"{prefix}_amp_max")
    )
    out = windows.join(got, by, "left")
    return out.withColumn(f"{prefix}_count", F.coalesce("_n", F.lit(0))).withColumn(f"{prefix}_amp_sum", F.coalesce("_s", F.lit(0.0))).drop("_n", "_s")


def bvp_features(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by).agg(*summary(F.col("value"), "bvp", "mean", "std", "median", "iqr", "min", "max", "range"))


def temperature_features(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by).agg(*summary(F.col("value"), "temp", "mean", "median", "std", "min", "max", "range", "iqr", "slope", seconds=F.col("t")))


def interbeat_features(windows: DataFrame, beats: DataFrame, by: list[str], window_s: float, low: float = 0.33, high: float = 2.0, least: int = 10, coverage: float = 0.5) -> DataFrame:
    """Beat count, valid intervals and their share of the window; rates where enough of both.

    Intervals are between consecutive beats (by, t) of one window. Windows without beats stay.
    """
    w = Window.partitionBy(*by).orderBy("t")
    ibi = F.col("t") - F.lag("t").over(w)
    timed = beats.withColumn("ibi", ibi).withColumn("ibi", F.when(F.col("ibi").between(low, high), F.col("ibi")))
    rate = F.lit(60.0) / F.col("ibi")
    got = timed.groupBy(*by).agg(
        F.count("*").alias("_beats"), F.count("ibi").alias("_valid"), (F.coalesce(F.sum("ibi"), F.lit(0.0)) / F.lit(window_s)).alias("_cover"),
        F.avg(rate).alias("hr_mean"), F.percentile(rate, F.lit(0.5)).alias("hr_median"), F.stddev_pop(rate).alias("hr_std"),
        F.min(rate).alias("hr_min"), F.max(rate).alias("hr_max"),
    )
    out = windows.join(got, by, "left")
    enough = (F.coalesce("_valid", F.lit(0)) >= least) & (F.coalesce("_cover", F.lit(0.0)) >= coverage)
    for c in ("hr_mean", "hr_median", "hr_std", "hr_min", "hr_max"):
        out = out.withColumn(c, F.when(enough, F.col(c)))
    return (
        out.withColumn("bvp_beat_count", F.coalesce("_beats", F.lit(0))).withColumn("bvp_valid_ibi_count", F.coalesce("_valid", F.lit(0)))
        .withColumn("bvp_beat_coverage", F.coalesce("_cover", F.lit(0.0))).withColumn("q_bvp_hr_available", enough).drop("_beats", "_valid", "_cover")
    )


def null_after_error(features: DataFrame, families: list[list[str]], error_family: str = "error_family") -> DataFrame:
    """Null the columns of the family numbered ``error_family`` (from 0; null: none) and of all later ones."""
    kept = [c for c in features.columns if c not in {x for f in families for x in f}]
    cols = [F.when(F.col(error_family).isNull() | (F.col(error_family) > k), F.col(c)).alias(c) for k, f in enumerate(families) for c in f]
    return features.select(*kept, *cols)
