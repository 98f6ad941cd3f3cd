"""Abstention policies: which predictions to make, and what error and coverage follow.

The policies (always, raw confidence, calibrated confidence, signal quality) are named by
the plan of the study this package serves; their details are this package's own choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("always_predict", "raw_confidence", "calibrated_confidence", "signal_quality")


def confidence(probability: Column) -> Column:
    return F.greatest(probability, F.lit(1.0) - probability)


def calibrated(probability: Column, slope: float, intercept: float) -> Column:
    """Sigmoid of a linear function of the score; slope and intercept come from development rows."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * probability + F.lit(intercept))))


def predicted(policy: str, threshold: float = 0.0, slope: float = 1.0, intercept: float = 0.0) -> Column:
    """Whether a row (prob_positive, q_structural_ok) is predicted under a policy."""
    rules = {
        "always_predict": F.lit(True), "raw_confidence": confidence(F.col("prob_positive")) >= threshold,
        "calibrated_confidence": confidence(calibrated(F.col("prob_positive"), slope, intercept)) >= threshold, "signal_quality": F.coalesce(F.col("q_structural_ok"), F.lit(False)),
    }
    if policy not in rules:
        raise ValueError(f"unknown policy {policy}")
    return rules[policy]


def outcomes(rows: DataFrame, policy: Column, by: list[str]) -> DataFrame:
    """Coverage over all rows, and error among the predicted labelled ones (null without any)."""
    judged = policy & F.col("y").isNotNull()
    wrong = F.count_if(judged & (F.col("hard") != F.col("y")))
    n = F.count_if(judged)
    return rows.groupBy(*by).agg((F.count_if(policy) / F.count("*")).alias("coverage"), n.alias("n_judged"), F.when(n > 0, wrong / n).alias("error_rate"))


def threshold_for_coverage(development: DataFrame, coverage: float) -> float:
    """The confidence that keeps a share of the development rows; fixed before held-out rows are seen."""
    return float(development.agg(F.percentile(confidence(F.col("prob_positive")), F.lit(1.0 - coverage))).first()[0])
