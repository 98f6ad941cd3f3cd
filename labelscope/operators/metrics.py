"""Participant-level metrics of binary predictions, as grouped relational queries.

Input rows are (group columns, y 0 or 1 or null, p, hard). Rows without a label count for
nothing. Where a metric needs a class that is not there it is null, never a stand-in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions import scalars as S
from labelscope.operators.ranked import running_totals


def confusion() -> list[Column]:
    """tn, fp, fn, tp, and the class counts n0, n1."""
    y, h = F.col("y"), F.col("hard")
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return [F.count_if((y == a) & (h == b)).alias(n) for n, (a, b) in cells.items()] + [F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1")]


def from_confusion(metrics: DataFrame) -> DataFrame:
    """Recalls, balanced accuracy and macro-F1 from confusion counts; null where classes are missing."""
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    f1 = lambda hit, a, b: F.when(2 * hit + a + b > 0, 2 * hit / (2 * hit + a + b)).otherwise(0.0)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    recall0, recall1 = F.when(F.col("n0") > 0, tn / F.col("n0")), F.when(F.col("n1") > 0, tp / F.col("n1"))
    return (
        metrics.withColumn("baseline_recall", recall0).withColumn("stress_recall", recall1)
        .withColumn("balanced_accuracy", F.when(both, (recall0 + recall1) / 2))
        .withColumn("macro_f1", F.when(both, (f1(tp, fp, fn) + f1(tn, fp, fn)) / 2))
    )


def classification_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    return from_confusion(rows.groupBy(*by).agg(*confusion()))


def require_both_classes(metrics: DataFrame) -> DataFrame:
    """The strict policy: a group with one class only is an error."""
    ok = F.when((F.col("n0") > 0) & (F.col("n1") > 0), F.lit(True)).otherwise(F.raise_error(F.lit("a participant has one class only")).cast("boolean"))
    return metrics.filter(ok)


def _by_score(rows: DataFrame, by: list[str]) -> DataFrame:
    """Class counts of every distinct score: the only thing ranking metrics need, aggregated before any sort."""
    return rows.filter("y IS NOT NULL").groupBy(*by, "p").agg(F.count_if(F.col("y") == 1).alias("_p1"), F.count_if(F.col("y") == 0).alias("_p0"))


def ranking_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """AUROC (ties averaged) and average precision (steps at distinct scores), both from one pass in order of the score."""
    s = running_totals(_by_score(rows, by), by, {"p": F.col("p")}, {"_p1": F.col("_p1"), "_p0": F.col("_p0")})
    tp, fp = F.col("_p1_total") - F.col("_p1_before"), F.col("_p0_total") - F.col("_p0_before")  # of this score or more
    s = s.withColumn("_below0", F.col("_p0_before")).withColumn("_tp", tp).withColumn("_all", tp + fp)
    got = s.groupBy(*by).agg(
        F.sum("_p1").alias("n1"), F.sum("_p0").alias("n0"),
        F.sum(F.col("_p1") * (F.col("_below0") + F.col("_p0") / F.lit(2.0))).alias("_wins"), F.sum(F.col("_p1") * F.col("_tp") / F.col("_all")).alias("_steps"),
    )
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    return got.select(
        *by, "n0", "n1", F.when(both, F.col("_wins") / (F.col("n1") * F.col("n0"))).alias("auroc"), F.when(both, F.col("_steps") / F.col("n1")).alias("average_precision")
    )


def probabilistic_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """Brier score (unclipped) and log loss (clipped); null without labels."""
    y, q = F.col("y"), S.clipped(F.col("p"))
    loss = -F.when(y == 1, F.log(q)).when(y == 0, F.log(F.lit(1.0) - q))
    square = F.when(y.isNotNull(), (F.col("p") - y) * (F.col("p") - y))
    return rows.groupBy(*by).agg(F.count("y").alias("n_labels"), F.avg(square).alias("brier"), F.avg(loss).alias("log_loss"))


def across_participants(metrics: DataFrame, by: list[str], value: str) -> DataFrame:
    """Every participant weighs the same: mean, median, sample std (null for one), min, max, n."""
    return metrics.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"),
    )


def family_summary(metrics: DataFrame, families: list[str], value: str = "balanced_accuracy") -> DataFrame:
    """Summary per family with its rank: best mean first, the listed order deciding ties."""
    order = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(i))])
    out = across_participants(metrics, ["model_family"], value).withColumn("_o", order[F.col("model_family")])
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("mean"), "_o"))).drop("_o")


def average_rank(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rank from 1 with ties averaged, and percentile rank from 0 to 1 (0 for a group of one).

    Null is a value of its own, below all others. Values are counted first, so that equal
    ones are one row, and ranks come from running totals of those counts.
    """
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = running_totals(counted, by, {"value": F.col(value)}, {"_n": F.col("_n")})
    rank, n = F.col("_n_before") + 1 + (F.col("_n") - 1) / F.lit(2.0), F.col("_n_total")
    ranks = placed.select(*[F.col(c).alias(f"_r_{c}") for c in (*by, value)], rank.alias("average_rank"), F.when(n == 1, F.lit(0.0)).otherwise((rank - 1) / (n - 1)).alias("percentile_rank"))
    return rows.join(ranks, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in (*by, value)]).select(*rows.columns, "average_rank", "percentile_rank")


def select_best(scores: Column, tolerance: float = 1e-12) -> Column:
    """Position (from 0) of the best of an array of scores in order: a later one must beat the accepted one by more than the tolerance."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("best"), F.element_at(scores, 1).alias("score"))

    def step(state: Column, score: Column) -> Column:
        better = score > state["score"] + F.lit(tolerance)
        return F.struct(
            (state["at"] + 1).alias("at"), F.when(better, state["at"]).otherwise(state["best"]).alias("best"), F.when(better, score).otherwise(state["score"]).alias("score")
        )

    return F.aggregate(scores, start, step, lambda s: s["best"])


def risk_coverage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Error among the most confident share of labelled predictions, at every distinct confidence."""
    wrong = F.when(F.col("hard") != F.col("y"), 1).otherwise(0)
    s = rows.filter("y IS NOT NULL").withColumn("confidence", F.greatest(F.col("p"), 1 - F.col("p")))
    s = s.groupBy(*by, "confidence").agg(F.count("*").alias("_n"), F.sum(wrong).alias("_e"))
    s = running_totals(s, by, {"confidence": F.col("confidence")}, {"_n": F.col("_n"), "_e": F.col("_e")})
    n, e = F.col("_n_total") - F.col("_n_before"), F.col("_e_total") - F.col("_e_before")  # of this confidence or more
    return s.select(*by, "confidence", n.alias("n_kept"), (n / F.col("_n_total")).alias("coverage"), (e / n).alias("error_rate"))
