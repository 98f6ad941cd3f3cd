"""The observation study from frozen predictions: every table of it, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.operators import observe as O  # noqa: E741


def run(predictions: DataFrame, labels: DataFrame, least: int, repetitions: int = O.REPETITIONS, fractions: tuple[str, ...] = O.FRACTIONS) -> dict[str, DataFrame]:
    """Tables from predictions (participant_id, window_id, model_family, prob_positive, hard) and labels (.., y).

    Random realisations are observed once and used by every table that needs them.
    """
    rows = O.labelled(predictions.drop("y"), labels)
    full = O.full_metrics(rows).cache()
    targeted = O.targeted_mask(predictions, fractions)
    seen_t, seen_r = O.observed_metrics(targeted, rows, ["fraction"]).cache(), O.random_observed(rows, fractions, repetitions).cache()
    d_t, d_r = O.distortion(seen_t, full, ["fraction"]), O.distortion(seen_r, full, ["fraction", "rep"])
    contrasts = O.contrast(d_t, d_r, repetitions, O.budgets(predictions, fractions))
    regret_t, regret_r = O.selection_regret(seen_t, full, ["fraction"], least), O.selection_regret(seen_r, full, ["fraction", "rep"], least)
    return {
        "budgets": O.budgets(predictions, fractions), "targeted_masks": targeted, "full": full, "observed_targeted": seen_t, "observed_random": seen_r,
        "yield_targeted": O.label_yield(targeted, labels, ["fraction"]), "distortion_targeted": d_t, "contrasts": contrasts, "selection_targeted": regret_t,
        "selection_random": O.selection_summary(regret_r, ["fraction"]), "summary_ba": O.contrast_summary(contrasts, "c_ba"), "summary_brier": O.contrast_summary(contrasts, "c_brier"),
        "summary_log_loss": O.contrast_summary(contrasts, "c_log_loss"), "summary_estimable": O.contrast_summary(contrasts, "c_estimable"),
        "control": O.control_violations(seen_t.filter("fraction = '1.00'"), full),
    }
