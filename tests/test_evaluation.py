from __future__ import annotations

import itertools

import numpy as np
import pytest
from labelscope.operators import metrics as M
from labelscope.operators import abstain, models, observe, splits
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

SCHEMA = "participant_id string, window_id string, model_family string, prob_positive double, hard int"


def rows_of(spark, y, p, hard=None, who="S2", family="logistic"):
    hard = hard or [int(x >= 0.5) for x in p]
    return spark.createDataFrame([(who, f"w{i:05d}", family, float(b), int(h), a, float(b)) for i, (a, b, h) in enumerate(zip(y, p, hard, strict=True))], SCHEMA + ", y int, p double")


def test_metrics_follow_the_stored_prediction(spark):
    r = M.classification_metrics(rows_of(spark, [0, 0, 1, 1, 1], [0.5] * 5, [0] * 5), ["participant_id"]).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"], r["balanced_accuracy"]) == (2, 0, 3, 0, 0.5)


# committed results of 15-fold runs: (tn, fp, fn, tp) -> balanced accuracy, macro F1
@pytest.mark.parametrize(("cells", "ba", "f1"), [((18, 0, 1, 9), 0.95, 0.9601706970128023), ((16, 2, 1, 9), 0.8944444444444444, 0.8857142857142857), ((3, 16, 0, 10), 0.5789473684210527, 0.41414141414141414), ((18, 0, 10, 0), 0.5, 0.391304347826087)])
def test_known_metrics(spark, cells, ba, f1):
    y = [0] * (cells[0] + cells[1]) + [1] * (cells[2] + cells[3])
    hard = [0] * cells[0] + [1] * cells[1] + [0] * cells[2] + [1] * cells[3]
    r = M.classification_metrics(rows_of(spark, y, [0.5] * len(y), hard), ["participant_id"]).first()
    assert abs(r["balanced_accuracy"] - ba) < 1e-12 and abs(r["macro_f1"] - f1) < 1e-12


def test_ranking_against_pairs(spark):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 120), np.round(rng.random(120), 1)
    r = M.ranking_metrics(rows_of(spark, y.tolist(), p.tolist()), ["participant_id"]).first()
    wins = [(a > b) + 0.5 * (a == b) for a, b in itertools.product(p[y == 1], p[y == 0])]
    order = sorted(set(p), reverse=True)
    ap, before = 0.0, 0
    for t in order:
        tp = int(((p >= t) & (y == 1)).sum())
        ap += (tp - before) / y.sum() * tp / (p >= t).sum()
        before = tp
    assert abs(r["auroc"] - np.mean(wins)) < 1e-12 and abs(r["average_precision"] - ap) < 1e-12


def test_missing_classes_are_null_or_an_error(spark):
    one = rows_of(spark, [1, 1, None], [0.2, 0.9, 0.4])
    c = M.classification_metrics(one.filter("y is not null"), ["participant_id"])
    r = c.first()
    assert r["balanced_accuracy"] is None and r["macro_f1"] is None and r["baseline_recall"] is None and r["stress_recall"] == 0.5
    assert M.ranking_metrics(one, ["participant_id"]).first()["auroc"] is None
    q = M.probabilistic_metrics(one, ["participant_id"]).first()
    assert q["n_labels"] == 2 and abs(q["brier"] - (0.64 + 0.01) / 2) < 1e-12
    assert M.probabilistic_metrics(one.filter("y is null"), ["participant_id"]).first()["brier"] is None
    with pytest.raises(PySparkException):
        M.require_both_classes(c).collect()


def test_log_loss_is_clipped_and_brier_is_not(spark):
    r = M.probabilistic_metrics(rows_of(spark, [1, 0], [0.0, 1.0]), ["participant_id"]).first()
    assert r["brier"] == 1.0 and abs(r["log_loss"] + np.log(np.finfo(float).eps)) < 1e-9


def test_participants_weigh_the_same(spark):
    df = spark.createDataFrame([("m", "S2", 1.0), ("m", "S3", 0.5), ("m", "S4", 0.0), ("k", "S2", 0.7)], "model_family string, participant_id string, balanced_accuracy double")
    got = {r["model_family"]: r for r in M.family_summary(df, ["k", "m"]).collect()}
    assert got["m"]["mean"] == 0.5 and abs(got["m"]["std"] - 0.5) < 1e-12 and got["k"]["std"] is None and got["k"]["position"] == 1


@pytest.mark.parametrize(("scores", "best"), [([0.7, 0.7 + 5e-13, 0.69], 0), ([0.7, 0.7 + 1e-9], 1), ([0.7, 0.7 + 8e-13, 0.7 + 1.6e-12], 2), ([0.1], 0)])
def test_select_best(spark, scores, best):
    assert spark.range(1).select(M.select_best(F.array(*[F.lit(s) for s in scores]))).first()[0] == best
    made = [{"candidate": i, "score": s} for i, s in enumerate(scores)]
    assert models.best_candidate(made) == best


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 3.0), ("b", 9.0)], "g string, v double")
    got = [(r["g"], r["average_rank"], round(r["percentile_rank"], 6)) for r in M.average_rank(df, ["g"], "v").orderBy("g", "v").collect()]
    assert got == [("a", 1.0, 0.0), ("a", 2.5, 0.5), ("a", 2.5, 0.5), ("a", 4.0, 1.0), ("b", 1.0, 0.0)]


# splits

COUNTS = {
    "S2": (18, 10), "S3": (18, 10), "S4": (19, 9), "S5": (19, 9), "S6": (19, 10), "S7": (19, 10), "S8": (19, 11), "S9": (18, 9), "S10": (19, 11), "S11": (19, 11),
    "S13": (19, 10), "S14": (19, 10), "S15": (19, 11), "S16": (19, 10), "S17": (19, 11),
}


@pytest.mark.parametrize(
    ("outer", "want"),
    [
        ("S2", [["S13", "S15", "S3", "S5"], ["S11", "S4", "S6"], ["S10", "S14", "S17", "S9"], ["S16", "S7", "S8"]]),
        ("S10", [["S14", "S17", "S4"], ["S5", "S7", "S8"], ["S11", "S13", "S15", "S9"], ["S16", "S2", "S3", "S6"]]),
    ],
)
def test_known_inner_folds(outer, want):
    split = splits.inner_split(COUNTS, outer)
    assert [list(f.validation) for f in split.folds] == want and splits.from_dict(splits.to_dict(split)) == split


def test_inner_folds_of_tasks_are_those_of_the_splits(spark):
    counts = spark.createDataFrame([(who, *n) for who, n in COUNTS.items()], "participant_id string, n0 long, n1 long")
    got = {tuple(r) for r in splits.inner_folds(counts.repartition(3)).collect()}
    want = set()
    for outer in COUNTS:
        made = splits.inner_split(COUNTS, outer)
        want |= {(outer, made.seed, f.index, who, part) for f in made.folds for part, ids in (("train", f.train), ("validation", f.validation)) for who in ids}
    assert got == want and splits.inner_folds(counts.limit(0)).count() == 0


def test_bad_splits_are_refused():
    good = splits.inner_split(COUNTS, "S2")
    f = good.folds[0]
    for folds in (good.folds[1:], (splits.InnerFold(0, (*f.train, f.validation[0]), f.validation), *good.folds[1:]), (splits.InnerFold(0, (*f.train, "S2"), f.validation), *good.folds[1:])):
        with pytest.raises(splits.SplitError):
            splits.validate_inner(splits.InnerSplit("S2", good.seed, good.stream, tuple(folds)))


def test_outer_folds_cover_everyone_once(spark):
    p = spark.createDataFrame([(k,) for k in COUNTS], "participant_id string")
    folds = splits.lopo_folds(p)
    assert folds.filter("part = 'test'").orderBy("fold_index").select("outer_participant").first()[0] == "S2" and folds.count() == 225
    assert splits.cover_violations(folds, p).isEmpty()
    assert {r["participant_id"] for r in splits.cover_violations(folds.filter("fold_index < 14"), p).collect()} == {"S17"}
    with pytest.raises(splits.SplitError):
        splits.assert_disjoint(p, p.filter("participant_id = 'S3'"))


# training statistics and models


def test_medians_scaler_majority_ratio(spark):
    df = spark.createDataFrame([(1.0, None, 0), (3.0, None, 0), (None, None, 1), (float("nan"), None, 1)], "a double, b double, y int")
    r = models.training_medians(df, ["a", "b"]).first()
    assert (r["a"], r["b"], r["all_missing"]) == (2.0, 0.0, ["b"])
    s = models.training_scaler(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).first()
    assert (s["mean_a"], s["std_a"], s["std_b"]) == (2.0, 1.0, 1.0)
    for y, want in (([0, 0, 0, 1], 0), ([0, 1], 0), ([1, 1, 0], 1)):
        assert models.majority_baseline(spark.createDataFrame([(v,) for v in y], "y int")).first()["majority_label"] == want
    assert models.class_ratio(df).first()["ratio"] == 1.0
    with pytest.raises(PySparkException):
        models.class_ratio(df.filter("y = 0")).collect()


def test_grids():
    models.assert_grids_frozen()
    assert models.GRIDS["logistic"][0].candidate_id == "logistic:C=0.1,class_weight=None"
    assert models.GRIDS["random_forest"][1].candidate_id == "random_forest:max_depth=3,min_samples_leaf=5,class_weight=balanced"
    assert models.GRIDS["xgboost"][3].candidate_id == "xgboost:max_depth=2,learning_rate=0.1,class_weight_mode=training_ratio"


@pytest.fixture(scope="module")
def study_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(f"S{k}", f"x:S{k}:w{i:05d}", None if i % 5 == 4 else int(i % 5 >= 2 and i % 5 < 4), float(rng.normal(1.5 * (i % 5 in (2, 3)) + 0.1 * k)), None if i % 7 == 0 else float(rng.normal())) for k in range(2, 8) for i in range(20)]
    return spark.createDataFrame(rows, "participant_id string, window_id string, y int, a double, b double").cache()


def test_held_out_labels_never_reach_the_model(spark, study_rows):
    grids = {"logistic": models.GRIDS["logistic"][:2]}
    run = lambda r: {x["window_id"]: (x["prob_positive"], x["candidate_id"]) for x in models.out_of_fold_predictions(r, ["a", "b"], ["logistic"], n_inner=2, grids=grids, outer=["S3"]).collect()}
    got = run(study_rows)
    flipped = run(study_rows.withColumn("y", F.when(F.col("participant_id") == "S3", 1 - F.col("y")).otherwise(F.col("y"))))
    assert len(got) == 20 and got == flipped


def test_families_predict_every_window(spark, study_rows):
    grids = {f: g[:1] for f, g in models.GRIDS.items()}
    families = [*models.GRIDS, "majority"]
    made = models.out_of_fold_predictions(study_rows, ["a", "b"], families, n_inner=2, grids=grids, outer=["S2"], trees=5, rounds=3).cache()
    held = study_rows.filter("participant_id = 'S2'")
    assert made.count() == 80 and models.prediction_faults(made, held, families).isEmpty()
    seed = {r["model_family"]: r["model_seed"] for r in made.collect()}
    assert seed["logistic"] == 1718432981 and seed["majority"] is None
    broken = made.filter("window_id <> 'x:S2:w00003' or model_family <> 'logistic'")
    assert [(r["fault"], r["model_family"], r["n"]) for r in models.prediction_faults(broken, held, families).collect()] == [("missing", "logistic", 1)]


def test_calibration_slope_and_intercept(spark):
    rng = np.random.default_rng(3)
    s = rng.random(4000)
    y = rng.random(4000) < 1 / (1 + np.exp(-(4 * s - 2)))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "prob_positive double, y int")
    slope, intercept = models.sigmoid_calibration(df)
    assert abs(slope - 4) < 0.5 and abs(intercept + 2) < 0.3


# observation policies


@pytest.fixture(scope="module")
def predictions(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n in ((2, 40), (3, 17), (4, 1), (5, 12), (6, 30)):
        for i in range(n):
            for f in (*observe.FAMILIES, "majority"):
                p = 0.35 if f == "majority" else round(float(rng.random()), 1)
                rows.append((f"S{k}", f"x:S{k}:w{i:05d}", f, p, int(p >= 0.5)))
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark, predictions):
    w = predictions.select("participant_id", "window_id").distinct()
    k = F.pmod(F.xxhash64("window_id"), F.lit(4))
    y = F.when(F.col("participant_id") == "S5", F.lit(None)).when(k == 0, 0).when(k == 1, 1)
    return w.withColumn("y", y.cast("int")).cache()


def masks_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_masks_have_exactly_their_budget(spark, predictions):
    b = {(r["participant_id"], r["fraction"]): r["budget"] for r in observe.budgets(predictions).collect()}
    assert b["S3", "0.25"] == 4 and b["S4", "0.50"] == 0 and b["S4", "1.00"] == 1 and b["S2", "0.75"] == 30
    for mask, by in ((observe.targeted_mask(predictions), []), (observe.random_masks(predictions, repetitions=5), ["rep"])):
        n = mask.groupBy("participant_id", "fraction", *by).agg(F.count("*").alias("n"), F.countDistinct("window_id").alias("d")).collect()
        assert all(r["n"] == r["d"] == b[r["participant_id"], r["fraction"]] for r in n) and len(n) == (len(b) - 3) * (5 if by else 1)


def test_masks_ignore_row_order_and_labels(spark, predictions):
    shuffled = predictions.orderBy(F.xxhash64("window_id", "model_family")).repartition(7)
    assert masks_of(observe.targeted_mask(predictions)) == masks_of(observe.targeted_mask(shuffled))
    assert masks_of(observe.random_masks(predictions, repetitions=3)) == masks_of(observe.random_masks(shuffled, repetitions=3))


def test_random_draw_is_the_named_one(spark, predictions):
    seed = splits.seed_of(42, "study_a_random:S2:0.50:2")
    names = sorted(r[0] for r in predictions.filter("participant_id = 'S2'").select("window_id").distinct().collect())
    want = sorted(names[i] for i in np.random.default_rng(seed).choice(40, size=20, replace=False))
    got = sorted(r["window_id"] for r in observe.random_masks(predictions, repetitions=3).filter("participant_id = 'S2' and fraction = '0.50' and rep = 2").collect())
    assert got == want


def test_ties_go_by_the_digest(spark):
    import hashlib

    rows = [("S2", f"w{i}", f, 0.5, 1) for i in range(10) for f in observe.FAMILIES]
    got = {r["window_id"] for r in observe.targeted_mask(spark.createDataFrame(rows, SCHEMA), ("0.50",)).collect()}
    seed = splits.seed_of(42, observe.TIE_STREAM)
    assert got == set(sorted((f"w{i}" for i in range(10)), key=lambda w: hashlib.sha256(f"{seed}:S2:{w}".encode()).hexdigest())[:5])


def test_whole_study_and_its_control(spark, predictions, labels):
    from labelscope.plans import study

    t = study.run(predictions, labels, least=2, repetitions=10)
    assert t["control"].isEmpty()
    d = {r["participant_id"]: r for r in t["distortion_targeted"].filter("fraction = '1.00'").collect()}
    assert "S5" not in d and all(r["d_brier"] < 1e-12 and (r["d_ba"] is None or r["d_ba"] < 1e-12) for r in d.values())
    whole = t["selection_targeted"].filter("fraction = '1.00'").first()
    assert whole["estimable"] and abs(whole["r_cohort"]) < 1e-12 and abs(whole["r_subset"]) < 1e-12 and whole["top_model_changed"] is False
    c = {(r["participant_id"], r["fraction"]): r for r in t["contrasts"].collect()}
    assert len(c) == 20 and c["S5", "0.50"]["c_ba"] is None and c["S5", "0.50"]["c_estimable"] == 0.0 and abs(c["S2", "1.00"]["c_ba"]) < 1e-12
    assert t["summary_estimable"].filter("fraction = '0.50'").first()["n_evaluable"] == 5
    y = {r["participant_id"]: r for r in t["yield_targeted"].filter("fraction = '0.50'").collect()}
    assert y["S5"]["label_yield_fraction"] == 0 and y["S5"]["ba_estimable"] is False and y["S5"]["stress_coverage"] is None and y["S2"]["selected_count"] == 20
    few = observe.selection_regret(t["observed_targeted"], t["full"], ["fraction"], least=5).collect()
    assert all(not r["estimable"] and r["selected_model"] is None and r["r_cohort"] is None for r in few)


def test_mixture_keeps_the_budget(spark, predictions):
    one = observe.random_masks(predictions, ("0.50",), 1).drop("rep")
    order = observe.consensus(predictions).withColumn("place", F.struct(-F.col("consensus_score"), F.col("window_id")))
    got = observe.audit_mixture(observe.targeted_mask(predictions, ("0.50",)), one, observe.budgets(predictions, ("0.50",)), order, 0.3)
    n = {r["participant_id"]: (r["n"], r["d"]) for r in got.groupBy("participant_id").agg(F.count("*").alias("n"), F.countDistinct("window_id").alias("d")).collect()}
    assert n == {"S2": (20, 20), "S3": (8, 8), "S5": (6, 6), "S6": (15, 15)}


def test_unknown_is_not_negative(spark):
    r = observe.label_bounds(rows_of(spark, [1, 0, None, None], [0.9, 0.9, 0.1, 0.8]), ["participant_id"]).first()
    assert (r["accuracy_low"], r["accuracy_high"], r["n_labels"]) == (0.25, 0.75, 2)


def test_abstention(spark):
    df = rows_of(spark, [1, 0, 1, None], [0.9, 0.9, 0.55, 0.2]).withColumn("q_structural_ok", F.col("window_id") != "w00001")
    run = lambda name, t=0.0: tuple(abstain.outcomes(df, abstain.predicted(name, t, 8.0, -4.0), ["participant_id"]).first())[1:]
    assert run("always_predict") == (1.0, 3, 1 / 3) and run("raw_confidence", 0.8) == (0.75, 2, 0.5) and run("signal_quality") == (0.75, 2, 0.0)
    assert run("calibrated_confidence", 0.95) == (0.5, 2, 0.5) and run("raw_confidence", 0.99) == (0.0, 0, None)
    assert abs(abstain.threshold_for_coverage(df, 0.5) - 0.85) < 1e-9
    with pytest.raises(ValueError):
        abstain.predicted("never")


def test_random_realisations_equal_their_masks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    made = [(f"S{i}", f"w{w:04d}", f, float(rng.random()), 0, None if w % 4 == 3 else int(rng.random() < 0.4 + 0.05 * i)) for i in range(2, 6) for w in range(13 + 9 * i) for f in (*observe.FAMILIES, "majority")]
    made = [(a, b, c, p, int(p >= 0.5), y) for a, b, c, p, _, y in made]
    rows = observe.labelled(spark.createDataFrame([m[:5] for m in made], SCHEMA), spark.createDataFrame(sorted({(m[0], m[1], m[5]) for m in made if m[2] == "logistic"}, key=str), "participant_id string, window_id string, y int"))
    monkeypatch.setattr(observe, "REPETITION_BLOCK", 3)
    monkeypatch.setattr(observe, "MASK_CELLS", 100)
    masks = observe.random_masks(rows.filter("model_family = 'logistic'"), repetitions=8)
    key = ["participant_id", "fraction", "rep", "model_family"]
    want = {tuple(r[k] for k in key): r for r in observe.observed_metrics(masks, rows, ["fraction", "rep"]).collect()}
    got = {tuple(r[k] for k in key): r for r in observe.random_observed(rows, repetitions=8).collect()}
    assert len(want) == 4 * 4 * 8 * 4 and got.keys() == want.keys()
    for k, w in want.items():
        for name in ("tn", "fp", "fn", "tp", "n0", "n1", "balanced_accuracy", "macro_f1", "brier", "log_loss", "baseline_recall", "stress_recall"):
            a, b = got[k][name], w[name]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_a_single_class_participant_is_an_error_inside(spark):
    rows = [(f"S{i}", f"w{w}", 0 if i == 2 else w % 2, float(w % 2) + 0.1 * w) for i in range(2, 7) for w in range(6)]
    table = spark.createDataFrame(rows, "participant_id string, window_id string, y int, a double")
    split = splits.InnerSplit("S6", 1, "inner_split:S6", (splits.InnerFold(0, ("S3", "S4"), ("S2", "S5")),))
    with pytest.raises(PySparkException):
        models.evaluate_candidates("logistic", table, ["a"], split, 1, models.GRIDS["logistic"][:1])
    assert models.evaluate_candidates("logistic", table, ["a"], split, 1, models.GRIDS["logistic"][:1], skip_single_class=True)[0]["score"] is not None


@pytest.mark.parametrize("n", [1, 2, 999, 20_000])
def test_medians_of_large_and_tied_columns(spark, n):
    rng = np.random.default_rng(n)
    cols = {"a": rng.normal(size=n), "b": np.round(rng.normal(size=n)), "c": np.where(rng.random(n) < 0.5, np.nan, rng.exponential(size=n)), "d": np.zeros(n), "e": np.full(n, np.nan)}
    cols["b"][n // 3 : n // 2] = np.inf
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols.values(), strict=True)], ", ".join(f"{c} double" for c in cols)).repartition(5)
    r = models.training_medians(df, list(cols)).first()
    for c, v in cols.items():
        v = v[np.isfinite(v)]
        assert abs(r[c] - (np.median(v) if len(v) else 0.0)) < 1e-12
    assert "e" in r["all_missing"] and set(r["all_missing"]) == {c for c, v in cols.items() if not np.isfinite(v).any()}


def test_masks_are_made_in_blocks_of_windows(spark, monkeypatch):
    predictions = spark.createDataFrame([(f"S{i}", f"w{w:04d}", "logistic", 0.5, 1) for i in (2, 3) for w in range(70 * i)], SCHEMA)
    whole = sorted(map(tuple, observe.random_masks(predictions, repetitions=3).collect()))
    monkeypatch.setattr(observe, "MASK_BLOCK", 64)
    numbered = observe._numbered(predictions).cache()
    blocks = observe._mask_blocks(numbered, ("0.50", "1.00"), 2, 42).collect()
    n = {r["participant_id"]: r["count"] for r in numbered.groupBy("participant_id").count().collect()}
    for who, count in n.items():
        bits = lambda fraction, rep, who=who: sum(bin(w & (2**64 - 1)).count("1") for r in blocks if (r["participant_id"], r["fraction"], r["rep"]) == (who, fraction, rep) for w in r["words"])
        assert [bits("0.50", 0), bits("1.00", 1)] == [count // 2, count]
    assert all(len(r["words"]) == 1 for r in blocks)
    assert sorted(map(tuple, observe.random_masks(predictions, repetitions=3).collect())) == whole


def test_realisations_are_summed_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    made = [(f"S{i}", f"w{w:04d}", f, float(rng.random())) for i in (2, 3) for w in range(70 * i) for f in observe.FAMILIES]
    y = F.pmod(F.xxhash64("window_id"), F.lit(3)).cast("int")
    rows = spark.createDataFrame([(*m, int(m[3] >= 0.5), m[3]) for m in made], f"{SCHEMA}, p double").withColumn("y", F.when(y < 2, y))
    get = lambda: {tuple(r[k] for k in ("participant_id", "fraction", "rep", "model_family")): r for r in observe.random_observed(rows, repetitions=4).collect()}
    whole = get()
    monkeypatch.setattr(observe, "MASK_BLOCK", 64)
    parts = get()
    assert whole.keys() == parts.keys() and len(whole) == 2 * 4 * 4 * 3
    assert all(whole[k][c] == parts[k][c] for k in whole for c in ("tn", "fp", "fn", "tp")) and all(abs(whole[k][c] - parts[k][c]) < 1e-12 for k in whole for c in ("brier", "log_loss"))


def test_audit_mixture_ranks_without_a_window_over_a_participant(spark, predictions, monkeypatch):
    seen = []
    ranked = observe.running_totals
    order = observe.consensus(predictions).select("participant_id", "window_id", F.struct("window_id").alias("place"))
    one = predictions.select("participant_id", "window_id").distinct().withColumn("fraction", F.lit("0.50"))
    monkeypatch.setattr(observe, "running_totals", lambda rows, by, *a, **k: seen.append(by) or ranked(rows, by, *a, **k))
    got = observe.audit_mixture(None, one, observe.budgets(predictions, ("0.50",)), order, 0.3)
    counts = {r["participant_id"]: r["count"] for r in got.groupBy("participant_id").count().collect()}
    assert seen == [["participant_id", "fraction"]] * 2 and counts == {"S2": 20, "S3": 8, "S5": 6, "S6": 15}
