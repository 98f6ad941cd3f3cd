"""Quality flags of windows, as aggregates over their samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions import scalars as S


@dataclass(frozen=True)
class QualityParams:
    constant_epsilon: float = 1e-9
    rail_count: float = 127.0
    eda_floor: float = 0.01
    temp_low: float = 20.0
    temp_high: float = 45.0


def _range(value: Column) -> Column:
    return F.coalesce(F.max(S.present(value)) - F.min(S.present(value)), F.lit(0.0))


def modality_flags(samples: DataFrame, by: list[str], channels: list[str], expected: int, name: str, params: QualityParams = QualityParams()) -> DataFrame:
    """Sample count, whether it is as expected, finite share, and whether every channel is constant.

    A channel without a finite value has range 0; the finite share is over all channels.
    """
    finite = sum(S.finite(F.col(c)).cast("double") for c in channels) / len(channels)
    constant = F.lit(True)
    for c in channels:
        constant = constant & (_range(F.col(c)) < params.constant_epsilon)
    return samples.groupBy(*by).agg(
        F.count("*").alias(f"q_{name}_n_samples"), (F.count("*") == expected).alias(f"q_{name}_count_ok"),
        F.avg(finite).alias(f"q_{name}_finite_fraction"), constant.alias(f"q_{name}_constant"),
    )


def any_near_rail(channels: list[str], params: QualityParams = QualityParams()) -> Column:
    hit = F.lit(False)
    for c in channels:
        hit = hit | (S.finite(F.col(c)) & (F.abs(F.col(c)) >= params.rail_count))
    return F.coalesce(F.bool_or(hit), F.lit(False))


def any_below(value: Column, floor: float) -> Column:
    return F.coalesce(F.bool_or(S.finite(value) & (value < floor)), F.lit(False))


def any_outside(value: Column, low: float, high: float) -> Column:
    return F.coalesce(F.bool_or(S.finite(value) & ((value < low) | (value > high))), F.lit(False))


def structural_ok(modalities: list[str], error: str | None = "q_feature_error") -> Column:
    """Every modality complete, finite and not constant, and no error text."""
    ok = F.lit(True)
    for m in modalities:
        ok = ok & F.coalesce(F.col(f"q_{m}_count_ok"), F.lit(False)) & (F.col(f"q_{m}_finite_fraction") == 1.0) & ~F.coalesce(F.col(f"q_{m}_constant"), F.lit(True))
    return ok if error is None else ok & (F.coalesce(F.col(error), F.lit("")) == "")


def complete_flags(grid: DataFrame, flags: DataFrame, by: list[str], name: str) -> DataFrame:
    """Flags for every window of ``grid``; a window without samples has count 0, share 0 and is not constant."""
    return grid.join(flags, by, "left").fillna({f"q_{name}_n_samples": 0, f"q_{name}_finite_fraction": 0.0, f"q_{name}_count_ok": False, f"q_{name}_constant": False})
