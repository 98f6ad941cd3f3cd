"""Fixed windows over recordings: grid, sample assignment, reference annotation.

The grid comes from durations alone; labels are joined afterwards and never move,
drop or split a window. Samples of a regular stream find their window by arithmetic
on the index, so no range join is needed.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions import scalars as S


@dataclass(frozen=True)
class WindowSpec:
    """Length and step in seconds; windows start at the recording's start."""

    length_s: float = 60.0
    step_s: float | None = None
    origin_s: float = 0.0

    def __post_init__(self) -> None:
        if self.length_s <= 0 or self.step <= 0:
            raise ValueError("window length and step must be positive")
        if self.origin_s != 0:
            raise ValueError("windows start at 0")

    @property
    def step(self) -> float:
        return self.length_s if self.step_s is None else self.step_s


def window_grid(recordings: DataFrame, spec: WindowSpec, rates_hz: Mapping[str, float] | None = None, dataset: str = "events") -> DataFrame:
    """One row for each complete window of each row of ``recordings`` (participant_id, duration_s).

    For each named rate, the first and the end sample of the window. A recording shorter
    than a window has no row; a null duration neither.
    """
    n = S.window_count(F.col("duration_s"), spec.length_s, spec.step)
    counted = recordings.select("participant_id", n.alias("n")).filter("n > 0")
    grid = counted.select("participant_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("window_index"))
    start = F.col("window_index") * F.lit(float(spec.step))
    grid = grid.withColumn("start_seconds", start).withColumn("end_seconds", start + F.lit(float(spec.length_s)))
    for name, rate in (rates_hz or {}).items():
        for edge in ("start", "end"):
            grid = grid.withColumn(f"{name}_{edge}_sample", S.sample_index(F.col(f"{edge}_seconds"), F.lit(float(rate))))
    return grid.withColumn("window_id", S.window_id(F.lit(dataset), F.col("participant_id"), F.col("window_index")))


def window_of(index: Column, rate_hz: float, spec: WindowSpec) -> Column:
    """Window of a sample in a tumbling grid (half-open windows)."""
    return F.floor(index / F.lit(rate_hz * spec.length_s)).cast("int")


def assign_windows(samples: DataFrame, recordings: DataFrame, spec: WindowSpec, rate_hz: float = 1.0) -> DataFrame:
    """``samples`` (participant_id, sample_index, ...) with window_index; the tail after the last window goes.

    With a step below the length a sample is in several windows.
    """
    counts = recordings.select("participant_id", S.window_count(F.col("duration_s"), spec.length_s, spec.step).alias("_n"))
    if spec.step == spec.length_s:
        dealt = samples.withColumn("window_index", window_of(F.col("sample_index"), rate_hz, spec))
    else:
        time = F.col("sample_index") / F.lit(rate_hz)
        last = F.floor(time / F.lit(spec.step))
        first = F.greatest(F.lit(0), F.floor((time - F.lit(spec.length_s)) / F.lit(spec.step)) + 1)
        dealt = samples.withColumn("window_index", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return dealt.join(counts, "participant_id").filter("window_index < _n").drop("_n")


def annotate(grid: DataFrame, labels: DataFrame, expected_samples: int, reference: Mapping[int, int] = S.BINARY_REFERENCE) -> DataFrame:
    """Reference columns of every window of ``grid`` from ``labels`` (participant_id, window_index, code).

    A window is homogeneous when it holds one code and as many labels as it should;
    all others are mixed. No window is dropped.
    """
    seen = labels.groupBy("participant_id", "window_index").agg(
        F.count("code").alias("n_label_samples"), F.collect_set("code").alias("_codes"), F.min("code").alias("_lo"), F.max("code").alias("_hi")
    )
    full = (F.col("n_label_samples") == expected_samples) & (F.col("_lo") == F.col("_hi"))
    code = F.when(full, F.col("_lo").cast("short"))
    out = grid.join(seen, ["participant_id", "window_index"], "left").withColumn("homogeneous_raw_label", code)
    label = F.col("homogeneous_raw_label")
    return (
        out.withColumn("n_label_samples", F.coalesce("n_label_samples", F.lit(0)))
        .withColumn("raw_label_codes_present", F.coalesce(S.codes_text(F.col("_codes")), F.lit("")))
        .withColumn("is_label_homogeneous", label.isNotNull())
        .withColumn("condition_name", S.condition_name(label))
        .withColumn("analysis_label", S.binary_label(label, reference))
        .withColumn("binary_eligible", S.binary_label(label, reference).isNotNull())
        .withColumn("ineligibility_reason", S.ineligibility(label, reference))
        .drop("_codes", "_lo", "_hi")
    )


def usable_duration(streams: DataFrame) -> DataFrame:
    """participant_id, duration_s (the shortest stream), spread_s from (participant_id, n_samples, rate_hz)."""
    seconds = S.duration_s(F.col("n_samples"), F.col("rate_hz"))
    return streams.groupBy("participant_id").agg(F.min(seconds).alias("duration_s"), (F.max(seconds) - F.min(seconds)).alias("spread_s"))
