"""Baseline classifiers under leave-one-participant-out evaluation.

Statistics of training rows (medians, means, spreads, prevalence) are SQL aggregates;
models are Spark ML estimators with the same grids and protocol as described in the
README. Probabilities of other libraries are not reproduced.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions import scalars as S
from labelscope.operators import metrics as M
from labelscope.operators.splits import InnerSplit, inner_split, seed_of

THRESHOLD = 0.5


@dataclass(frozen=True)
class Candidate:
    family: str
    order: int
    params: dict = field(hash=False)

    @property
    def candidate_id(self) -> str:
        return S.candidate_id(self.family, self.params)

    def params_json(self) -> str:
        return json.dumps(self.params, sort_keys=True)


def _grid(family: str, **axes: tuple) -> tuple[Candidate, ...]:
    combos: list[dict] = [{}]
    for name, values in axes.items():
        combos = [c | {name: v} for c in combos for v in values]
    return tuple(Candidate(family, i, c) for i, c in enumerate(combos))


GRIDS = {
    "logistic": _grid("logistic", C=(0.1, 1.0, 10.0), class_weight=(None, "balanced")),
    "random_forest": _grid("random_forest", max_depth=(3, 6), min_samples_leaf=(5, 2), class_weight=(None, "balanced")),
    "xgboost": _grid("xgboost", max_depth=(2, 3), learning_rate=(0.03, 0.1), class_weight_mode=("none", "training_ratio")),
}
#: Trees of a forest and rounds of boosting; tests and small boxes take fewer.
TREES, ROUNDS = 300, 200


def assert_grids_frozen() -> None:
    sizes = {k: len(v) for k, v in GRIDS.items()}
    if sizes != {"logistic": 6, "random_forest": 8, "xgboost": 8}:
        raise AssertionError(f"candidate grids changed: {sizes}")


#: Relative accuracy of the brackets around a median.
BRACKET = 10_000


def training_medians(train: DataFrame, columns: list[str], bracket: int = BRACKET) -> DataFrame:
    """One row of medians over present values; a column without any has 0.0 and is named in ``all_missing``.

    Exact, without a column's values in one place: a sketch gives every column a bracket
    that its median is in, about 8 values in ``bracket`` wide; values below it are counted
    and only those inside are put in order.
    """
    values = {c: S.present(F.col(c).cast("double")) for c in columns}
    ends = F.array(F.lit(0.5 - 2 / bracket), F.lit(0.5 + 2 / bracket))
    ask = [F.struct(F.percentile_approx(v, ends, bracket).alias("ends"), F.count(v).alias("n")).alias(c) for c, v in values.items()]
    found = {c: r for c, r in train.agg(*ask).first().asDict().items() if r["n"]}
    empty = F.array(*[F.lit(c) for c in columns if c not in found]).cast("array<string>").alias("all_missing")
    zeros = train.sparkSession.range(1)
    if not found:
        return zeros.select(*[F.lit(0.0).alias(c) for c in columns], empty)
    each = [F.struct(F.lit(c).alias("c"), values[c].alias("v"), F.lit(r["ends"][0]).alias("low"), F.lit(r["ends"][1]).alias("high"), F.lit(r["n"]).alias("total")) for c, r in found.items()]
    long = train.select(F.inline(F.array(*each))).filter("v <= high")
    # all values below a bracket become one row
    counts = long.groupBy("c", "total", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("c").orderBy(F.col("v").asc_nulls_first()))
    reached = counts.withColumn("upto", upto).filter("v IS NOT NULL")
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    median = (at(F.floor((F.col("total") + 1) / 2)) + at(F.floor(F.col("total") / 2) + 1)) / 2
    wide = reached.groupBy("c").agg(median.alias("m")).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("m"))  # an entry a column
    return wide.select(*[F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)).alias(c) for c in columns], empty)


def training_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and population spreads (1 where there is none): mean_<c>, std_<c>."""
    out: list[Column] = []
    for c in columns:
        s = F.coalesce(F.stddev_pop(c), F.lit(0.0))
        out += [F.avg(c).alias(f"mean_{c}"), F.when(s > 0, s).otherwise(1.0).alias(f"std_{c}")]
    return train.agg(*out)


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(S.present(F.col(c)), F.lit(float(m))) for c, m in medians.items()})


def scale(df: DataFrame, stats: dict[str, float], columns: list[str]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(stats[f"mean_{c}"])) / F.lit(stats[f"std_{c}"]) for c in columns})


def majority_baseline(train: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Training prevalence and majority label (a prevalence of exactly one half gives 0)."""
    return train.groupBy(*by).agg(F.avg("y").alias("prevalence")).withColumn("majority_label", (F.col("prevalence") > 0.5).cast("byte"))


def class_ratio(train: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Negatives for each positive; an error without positives."""
    counts = train.groupBy(*by).agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    ratio = F.when(F.col("n1") > 0, F.col("n0") / F.col("n1")).otherwise(F.raise_error(F.lit("no positive training rows")).cast("double"))
    return counts.withColumn("ratio", ratio)


def estimator(candidate: Candidate, n_rows: int, seed: int, trees: int = TREES, rounds: int = ROUNDS):
    """The Spark ML estimator of a candidate."""
    p = candidate.params
    shared = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    if candidate.family == "logistic":
        # the intercept is the coefficient of a constant column, so it is penalised like the others
        return LogisticRegression(regParam=1.0 / (p["C"] * n_rows), elasticNetParam=0.0, standardization=False, fitIntercept=False, maxIter=200, **shared)
    if candidate.family == "random_forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=p["max_depth"], minInstancesPerNode=p["min_samples_leaf"], featureSubsetStrategy="sqrt", seed=seed, **shared)
    return GBTClassifier(maxIter=rounds, maxDepth=p["max_depth"], stepSize=p["learning_rate"], subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, **shared)


def weighted(train: DataFrame, candidate: Candidate, n0: int, n1: int) -> DataFrame:
    """Rows with the candidate's class weights (boosting weighs positives by the class ratio)."""
    p = candidate.params
    if p.get("class_weight") == "balanced":
        w0, w1 = (n0 + n1) / (2.0 * n0), (n0 + n1) / (2.0 * n1)
    else:
        w0, w1 = 1.0, (n0 / n1 if p.get("class_weight_mode") == "training_ratio" else 1.0)
    return train.withColumn("weight", F.when(F.col("y") == 1, F.lit(w1)).otherwise(F.lit(w0)))


@dataclass
class Fitted:
    """Statistics and model learned from training rows only."""

    columns: list[str]
    medians: dict[str, float]
    stats: dict[str, float] | None
    model: object

    def prepare(self, df: DataFrame) -> DataFrame:
        out = impute(df, self.medians)
        if not self.stats:
            return VectorAssembler(inputCols=self.columns, outputCol="features").transform(out)
        out = scale(out, self.stats, self.columns).withColumn("_one", F.lit(1.0))
        return VectorAssembler(inputCols=[*self.columns, "_one"], outputCol="features").transform(out).drop("_one")

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(self.prepare(df)).withColumn("prob_positive", vector_to_array("probability")[1])
        return df.join(scored.select("window_id", "prob_positive"), "window_id")


def fit(train: DataFrame, columns: list[str], candidate: Candidate, seed: int, trees: int = TREES, rounds: int = ROUNDS) -> Fitted:
    """Impute, scale (logistic only) and fit on eligible training rows (columns, y)."""
    rows = train.filter("y IS NOT NULL")
    got = training_medians(rows, columns).first()
    medians = {c: got[c] for c in columns}
    imputed = impute(rows, medians)
    stats = training_scaler(imputed, columns).first().asDict() if candidate.family == "logistic" else None
    n0, n1 = (rows.agg(F.count_if(F.col("y") == v).alias("n")).first()["n"] for v in (0, 1))
    if not n1 or not n0:
        raise ValueError("training rows need both classes")
    made = Fitted(columns, medians, stats, None)
    data = weighted(made.prepare(rows), candidate, n0, n1).withColumn("y", F.col("y").cast("double"))
    if candidate.family == "logistic":
        # every row and its mirror image: the same loss, and the column of ones has a spread, which the learner asks for
        mirrored = data.withColumn("features", array_to_vector(F.transform(vector_to_array("features"), lambda v: -v))).withColumn("y", 1 - F.col("y"))
        data = data.unionByName(mirrored)
    made.model = estimator(candidate, n0 + n1, seed, trees, rounds).fit(data)
    return made


def evaluate_candidates(
    family: str, rows: DataFrame, columns: list[str], split: InnerSplit, seed: int, candidates: tuple[Candidate, ...] | None = None, skip_single_class: bool = False, **size
) -> list[dict]:
    """Mean inner balanced accuracy (participants equally) of every candidate, in grid order.

    A validation participant with one class only is an error, or left out with ``skip_single_class``.
    """
    out = []
    for candidate in candidates or GRIDS[family]:
        scores: list[float] = []
        for fold in split.folds:
            model = fit(rows.filter(F.col("participant_id").isin(*fold.train)), columns, candidate, seed, **size)
            seen = model.predict(rows.filter(F.col("participant_id").isin(*fold.validation) & F.col("y").isNotNull()))
            seen = seen.withColumn("hard", S.hard_prediction(F.col("prob_positive"), THRESHOLD))
            judged = M.classification_metrics(seen, ["participant_id"])
            judged = judged.filter("balanced_accuracy IS NOT NULL") if skip_single_class else M.require_both_classes(judged)
            scores += [r["balanced_accuracy"] for r in judged.collect()]
        out.append({"candidate": candidate, "candidate_id": candidate.candidate_id, "score": sum(scores) / len(scores) if scores else None})
    return out


def best_candidate(scored: list[dict], tolerance: float = 1e-12) -> Candidate:
    """The first candidate that no later one beats by more than the tolerance, compared in order."""
    best = scored[0]
    for s in scored[1:]:
        if s["score"] is not None and (best["score"] is None or s["score"] > best["score"] + tolerance):
            best = s
    return best["candidate"]


def out_of_fold_predictions(
    rows: DataFrame, columns: list[str], families: list[str], seed: int = 42, n_inner: int = 4, grids: dict[str, tuple[Candidate, ...]] | None = None, outer: list[str] | None = None, threads: int = 6, skip_single_class: bool = False, **size
) -> DataFrame:
    """Predictions of every window of every held-out participant, by family.

    ``rows`` are (participant_id, window_id, y, columns). A candidate is chosen inside the
    training participants of each outer fold, refitted on their labelled rows, and applied
    to all windows of the participant left out. ``outer`` limits the folds that are run.
    Folds are independent jobs; ``threads`` of them are submitted at once.
    """
    rows = rows.cache()
    grids = grids or GRIDS
    counts = {r["participant_id"]: (r["n0"], r["n1"]) for r in class_counts(rows).collect()}  # one row a participant

    def one(number: int, who: str) -> DataFrame:
        out = None
        train, held = rows.filter(F.col("participant_id") != who), rows.filter(F.col("participant_id") == who)
        split = inner_split(counts, who, seed, n_inner) if any(len(grids[f]) > 1 for f in families if f in grids) else None
        for family in families:
            if family == "majority":
                prior = majority_baseline(train.filter("y IS NOT NULL")).first()
                seen, made, own = held.withColumn("prob_positive", F.lit(prior["prevalence"])), None, None
                seen = seen.withColumn("hard", F.lit(prior["majority_label"]).cast("byte"))
            else:
                own = seed_of(seed, f"model_fit:{family}:{who}")
                grid = grids[family]
                made = best_candidate(evaluate_candidates(family, train, columns, split, own, grid, skip_single_class, **size)) if len(grid) > 1 else grid[0]
                seen = fit(train, columns, made, own, **size).predict(held)
                seen = seen.withColumn("hard", S.hard_prediction(F.col("prob_positive"), THRESHOLD))
            seen = seen.select(
                "participant_id", "window_id", "y", F.lit(number).alias("outer_fold"), F.lit(family).alias("model_family"), "prob_positive", "hard",
                F.lit(made.candidate_id if made else None).cast("string").alias("candidate_id"), F.lit(made.params_json() if made else None).cast("string").alias("candidate_params"),
                F.lit(own).cast("long").alias("model_seed"),
            )
            out = seen if out is None else out.unionByName(seen)
        return out

    wanted = [(n, who) for n, who in enumerate(sorted(counts)) if outer is None or who in outer]
    with ThreadPoolExecutor(threads) as pool:
        made = list(pool.map(lambda x: one(*x), wanted))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("participant_id").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))


def sigmoid_calibration(scores: DataFrame, score: str = "prob_positive") -> tuple[float, float]:
    """Slope and intercept of a logistic fit of y on one score, from development rows (y not null)."""
    data = VectorAssembler(inputCols=[score], outputCol="features").transform(scores.filter("y IS NOT NULL").withColumn("y", F.col("y").cast("double")))
    model = LogisticRegression(labelCol="y", standardization=False, maxIter=200).fit(data)
    return float(model.coefficients[0]), float(model.intercept)


def prediction_faults(predictions: DataFrame, windows: DataFrame, families: list[str]) -> DataFrame:
    """(fault, model_family, n): missing, unknown, repeated or non-finite rows; empty where predictions are complete."""
    wanted = windows.select("window_id").withColumn("model_family", F.explode(F.array(*[F.lit(f) for f in families])))
    key = ["model_family", "window_id"]
    faults = {
        "missing": wanted.join(predictions.select(*key), key, "left_anti"), "unknown": predictions.select(*key).join(wanted, key, "left_anti"),
        "repeated": predictions.groupBy(*key).count().filter("count > 1"), "not_finite": predictions.filter(~S.finite(F.col("prob_positive"))),
    }
    out = None
    for name, rows in faults.items():
        one = rows.groupBy("model_family").agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "model_family", "n")
        out = one if out is None else out.unionByName(one)
    return out
