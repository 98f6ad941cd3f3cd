from __future__ import annotations

import numpy as np
import pytest
from labelscope.operators import models
from labelscope.operators import task_models as T
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(2, 9):
        for i in range(24):
            y = None if i % 6 == 5 else int(i % 6 in (2, 3))
            rows.append((f"S{k}", f"x:S{k}:w{i:05d}", y, float(rng.normal(1.5 * (i % 6 in (2, 3)) + 0.1 * k)), None if i % 7 == 0 else float(rng.normal())))
    return spark.createDataFrame(rows, "participant_id string, window_id string, y int, a double, b double").cache()


def test_logistic_agrees_with_the_other_path(spark, table):
    candidate = models.GRIDS["logistic"][2]
    train, held = table.filter("participant_id <> 'S3'"), table.filter("participant_id = 'S3'")
    spark_ml = {r["window_id"]: r["prob_positive"] for r in models.fit(train, ["a", "b"], candidate, 1).predict(held).collect()}
    t, h = train.filter("y is not null").toPandas(), held.toPandas()
    local = T.fit_predict(candidate, t[["a", "b"]].to_numpy(float), t["y"].to_numpy(float), h[["a", "b"]].to_numpy(float), 1, 10, 10)
    assert max(abs(spark_ml[w] - p) for w, p in zip(h["window_id"], local, strict=True)) < 2e-3


def test_the_intercept_is_penalised():
    x, y, w = np.zeros((50, 1)), np.r_[np.ones(40), np.zeros(10)], np.ones(50)
    for c in (0.01, 0.1, 10.0):
        slope, b = T.fit_logistic(x, y, c, w)
        assert abs(slope) < 1e-9 and abs(b + c * (50 / (1 + np.exp(-b)) - 40)) < 1e-2 * (1 + c)  # where the gradient vanishes
    assert T.fit_logistic(x, y, 0.01, w)[1] < 0.2 < np.log(4) - 0.1 < T.fit_logistic(x, y, 10.0, w)[1]


def test_a_tree_finds_the_cut_and_keeps_leaf_sizes():
    x = np.column_stack([np.random.default_rng(0).random(200), np.arange(200.0)])
    y = (np.arange(200) >= 120).astype(float)
    tree = T.grow(x, T._orders(x, np.arange(200)), y - y.mean(), np.ones(200), 3, 5, 0.0, lambda: np.arange(2), lambda r: float(y[r].mean()))
    assert tree.feature[0] == 1 and tree.cut[0] == 119.5 and (tree.predict(x) == y).all() and len(tree.value) == 3
    flat = T.grow(np.ones((20, 1)), T._orders(np.ones((20, 1)), np.arange(20)), y[:20] - 1, np.ones(20), 3, 1, 0.0, lambda: np.arange(1), lambda r: 0.5)
    assert len(flat.value) == 1


@pytest.mark.parametrize("family", ["random_forest", "xgboost"])
def test_ensembles_learn_and_repeat(family):
    rng = np.random.default_rng(3)
    x, held = rng.normal(size=(300, 6)), rng.normal(size=(500, 6))
    rule = lambda v: (v[:, 0] * v[:, 1] > 0).astype(float)
    c = models.GRIDS[family][-1]
    p = T.fit_predict(c, x, rule(x), held, 5, 60, 60)
    assert ((p >= 0.5) == rule(held)).mean() > 0.8 and (p == T.fit_predict(c, x, rule(x), held, 5, 60, 60)).all() and ((p >= 0) & (p <= 1)).all()


def test_predictions_cover_everything_and_ignore_held_out_labels(spark, table):
    families = [*models.GRIDS, "majority"]
    run = lambda df: T.out_of_fold_predictions(df, ["a", "b"], families, n_inner=3, grids={f: g[:2] for f, g in models.GRIDS.items()}, trees=5, rounds=5)
    got = run(table).cache()
    assert models.prediction_faults(got, table, families).isEmpty() and got.count() == 4 * table.count()
    flipped = run(table.withColumn("y", F.when(F.col("participant_id") == "S3", 1 - F.col("y")).otherwise(F.col("y"))))
    mine = lambda df: sorted((r["window_id"], r["model_family"], r["prob_positive"], r["candidate_id"]) for r in df.filter("participant_id = 'S3'").collect())
    assert mine(got) == mine(flipped)
    seeds = {r["model_family"]: r["model_seed"] for r in got.filter("participant_id = 'S2'").collect()}
    assert seeds["logistic"] == 1718432981 and seeds["majority"] is None
    assert {r["y"] for r in got.select("y").distinct().collect()} == {None, 0, 1}


def test_large_tables_go_the_other_way(spark, table, monkeypatch):
    monkeypatch.setattr(T, "BROADCAST_CELLS", 10)
    got = T.out_of_fold_predictions(table.filter("participant_id < 'S5'"), ["a", "b"], ["logistic"], grids={"logistic": models.GRIDS["logistic"][:1]})
    assert got.count() == 72


def test_the_query_runs_ensembles_of_full_size(spark, table, monkeypatch):
    from labelscope.plans import evaluation

    seen = {}
    size = lambda *a, trees=models.TREES, rounds=models.ROUNDS, **k: seen.update(trees=trees, rounds=rounds)
    monkeypatch.setattr(T, "out_of_fold_predictions", size)
    monkeypatch.setattr(evaluation, "training_rows", lambda spark, sf_dir: table)
    evaluation.oof_predictions(spark, "")
    assert seen == {"trees": 300, "rounds": 200}


def test_the_size_of_the_table_does_not_change_the_learners(spark, table, monkeypatch):
    some = table.filter("participant_id < 'S6'")
    run = lambda: sorted(map(tuple, T.out_of_fold_predictions(some, ["a", "b"], ["random_forest", "xgboost"], n_inner=3, grids={f: g[:1] for f, g in models.GRIDS.items()}, trees=5, rounds=5).collect()))
    small = run()
    monkeypatch.setattr(T, "BROADCAST_CELLS", 10)
    assert run() == small and len(small) == 2 * some.count()


def test_trees_grown_together_equal_trees_grown_alone():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 4))  # real values and large leaves: no splits that are equally good
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(float)
    w = np.where(y == 1, 1.7, 0.6)
    drawn = rng.integers(0, 600, (6, 600))
    rank = np.column_stack([np.unique(c, return_inverse=True)[1] for c in x.T])
    together = T.grow_together(x, rank, drawn, y, w, 4, 25, 4, np.random.default_rng(0))
    held = rng.normal(size=(400, 4))
    for rows, tree in zip(drawn, together, strict=True):
        xb, yb, wb = x[rows], y[rows], w[rows]
        alone = T.grow(xb, T._orders(xb, np.arange(600)), wb * (yb - np.average(yb, weights=wb)), wb, 4, 25, 0.0, lambda: np.arange(4), lambda r, yb=yb, wb=wb: float(np.average(yb[r], weights=wb[r])))
        assert len(alone.value) == len(tree.value) > 5 and np.allclose(alone.predict(held), tree.predict(held))
        assert np.allclose(sorted(alone.value), sorted(tree.value))
    few = T.grow_together(x, rank, drawn, y, w, 4, 25, 1, np.random.default_rng(0))
    assert any((a.feature != b.feature) for a, b in zip(few, together, strict=True)) and all(t.predict(x).min() >= 0 and t.predict(x).max() <= 1 for t in few)
    flat = T.grow_together(np.ones((20, 2)), np.zeros((20, 2), int), rng.integers(0, 20, (3, 20)), y[:20], w[:20], 4, 1, 2, np.random.default_rng(0))
    assert [len(t.value) for t in flat] == [1, 1, 1]


def test_equal_rows_are_one_cell_and_trees_are_those_of_the_rows():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 9, 4000), rng.integers(0, 5, 4000)]).astype(float)
    y = ((x[:, 0] * x[:, 1] + rng.normal(size=4000)) > 8).astype(float)
    w = np.where(y == 1, 1.5, 0.75)
    rank = T.ranks(x)
    cells = T.Cells.of(rank)
    assert len(cells.first) == len(np.unique(x, axis=0)) == 45 and (x[cells.first][cells.cell] == x).all() and np.allclose(cells.sums(w).sum(), w.sum())
    drawn = rng.integers(0, 4000, (3, 4000))
    for rows, tree in zip(drawn, T.grow_together(x, rank, drawn, y, w, 4, 40, 2, np.random.default_rng(0)), strict=True):
        xb, yb, wb = x[rows], y[rows], w[rows]
        alone = T.grow(xb, T._orders(xb, np.arange(4000)), wb * (yb - np.average(yb, weights=wb)), wb, 4, 40, 0.0, lambda: np.arange(2), lambda r, yb=yb, wb=wb: float(np.average(yb[r], weights=wb[r])))
        assert np.allclose(alone.predict(x), tree.predict(x)) and len(alone.value) == len(tree.value)
    g, h = w * (y - 0.4), w * 0.24
    value = lambda a, b: lambda r: float(a[r].sum() / (b[r].sum() + 1))
    by_rows = T.grow(x, T._orders(x, np.arange(4000)), g, h, 3, 1, 1.0, lambda: np.arange(2), value(g, h))
    cg, ch = cells.sums(g), cells.sums(h)
    by_cells = T.grow_by_ranks(cells, [np.unique(c) for c in x.T], np.arange(2), np.arange(45), cg, ch, 3, 1.0, value(cg, ch))
    assert (by_rows.feature, by_rows.cut) == (by_cells.feature, by_cells.cut) and np.allclose(by_rows.value, by_cells.value)


def lengths(n: int, seed: int):
    """Rows like the query's: lengths, one of 17 numbers with gaps, and a root of the lengths, which has their order."""
    rng = np.random.default_rng(seed)
    a = np.floor(np.exp(rng.normal(4, 1, n))) + 1
    x = np.column_stack([a, np.where(a > 20, rng.integers(0, 17, n), np.nan), np.sqrt(a)])
    return x, (rng.random(n) < 0.3 + 0.3 * (x[:, 1] > 8) + 0.2 * (a > 60)).astype(float)


@pytest.mark.parametrize("family", ["random_forest", "xgboost"])
def test_all_candidates_of_a_fold_are_fitted_at_once_and_on_a_grid_alike(family, monkeypatch):
    x, y = lengths(3000, 5)
    held = lengths(700, 6)[0]
    alone = [T.fit_predict(c, x, y, held, 9, 12, 12) for c in models.GRIDS[family]]  # trees grown together
    in_cells = [p for _, p in T.fits(models.GRIDS[family], x, y, held, 9, 12, 12)]
    assert max(np.abs(a - b).max() for a, b in zip(alone, in_cells, strict=True)) < 1e-9
    monkeypatch.setattr(T, "TOGETHER", 1)  # as with many rows
    monkeypatch.setattr(T, "GRID", 0)
    in_cells = list(T.fits(models.GRIDS[family], x, y, held, 9, 12, 12))
    monkeypatch.setattr(T, "GRID", 8)
    seen, boxes = [], T.grow_boxes
    monkeypatch.setattr(T, "grow_boxes", lambda *a, **k: seen.append(1) or boxes(*a, **k))
    on_grid = list(T.fits(models.GRIDS[family], x, y, held, 9, 12, 12))
    assert len(seen) == 8 * 12
    for ((_, few), p), ((medians, many), q) in zip(in_cells, on_grid, strict=True):
        assert np.abs(p - q).max() < 1e-9 and np.ptp(q) > 0.05
        assert np.abs(T.predict(family, (medians, many), held) - q).max() < 1e-9  # trees and boxes
        assert [(t.feature, t.cut) for t in few] == [(t.feature, t.cut) for t in many]


def test_a_tree_on_a_grid_is_that_of_the_rows():
    x, y = lengths(2500, 8)
    x = T.imputed(x)[1]
    grid = T.Grid.of(x)
    assert grid.axis == [1, 0, 1] and grid.shape == (17, len(np.unique(x[:, 0]))) and T.Grid.of(np.random.default_rng(0).normal(size=(200, 2))) is None
    every = lambda count: np.tile(np.arange(3), (count, 1))
    w = np.where(y == 1, 1.5, 0.75)
    sums = np.bincount(grid.place + (y == 1) * grid.shape[0] * grid.shape[1], minlength=2 * grid.shape[0] * grid.shape[1]).reshape(2, *grid.shape)
    made, boxes = T.grow_boxes(grid, sums, 4, every, lambda a, b: (0.75 * a + 1.5 * b, 1.5 * b), lambda h, g: g / h, 25)
    rows = T.grow(x, T._orders(x, np.arange(2500)), w * (y - np.average(y, weights=w)), w, 4, 25, 0.0, lambda: np.arange(3), lambda r: float(np.average(y[r], weights=w[r])))
    (tree,) = made
    assert len(tree.value) == len(rows.value) > 9 and np.allclose(tree.predict(x), rows.predict(x)) and np.allclose(made.totals(x), rows.predict(x))
    assert np.allclose(grid.filled(boxes).ravel()[grid.place], rows.predict(x))
    g, h = w * (y - 0.4), w * 0.24
    table = np.array([np.bincount(grid.place, v, sums[0].size) for v in (h, g)]).reshape(sums.shape)
    made, boxes = T.grow_boxes(grid, table, 3, every, lambda a, b: (a, b), lambda h, g: g / (h + 1), reg=1.0)
    cells = T.Cells.of(T.ranks(x))
    cg, ch = cells.sums(g), cells.sums(h)
    plain = T.grow_by_ranks(cells, grid.levels, np.arange(3), np.arange(len(ch)), cg, ch, 3, 1.0, lambda r: float(cg[r].sum() / (ch[r].sum() + 1)))
    assert len(made.value) == len(plain.value) > 5 and np.allclose(made.totals(x), plain.predict(x)) and np.allclose(grid.filled(boxes).ravel()[grid.place], plain.predict(x))


def test_trees_of_many_parts_stay_apart():
    x, y = lengths(400, 1)
    x = T.imputed(x)[1]
    sample = T.Sample.of(x, y, x[:0])
    parts = [T.fit_forest(sample, 3, 5, np.ones(400), n, n)[0] for n in (4, 2, 6)]
    every = T.Trees.of(parts)
    each = [t for p in parts for t in p]
    assert every.count == 12 and [(t.feature, t.cut, t.value) for t in every] == [(t.feature, t.cut, t.value) for t in each]
    assert np.allclose(every.totals(x), sum(t.predict(x) for t in each)) and np.allclose(every.dealt(3)[1].totals(x), sum(t.predict(x) for t in each[1::3]))
    assert T.Trees.of([]).dealt(1)[0].totals(x).tolist() == [0.0] * 400
    with pytest.raises(ValueError, match="different weights"):
        T.grow_together(x, T.ranks(x), np.arange(400)[None], y, np.arange(400.0), 3, 5, 1, np.random.default_rng(0))


def test_boosted_trees_grown_level_by_level_are_those_grown_alone():
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=(1500, 5))
        x[:, 2] = np.round(x[:, 2], 1)
        y, p, kept = (x[:, 0] * x[:, 1] + rng.normal(size=1500) > 0).astype(float), rng.random(1500), rng.random(1500) < 0.8
        cells, levels, cols = T.Cells.of(T.ranks(x)), [np.unique(c) for c in x.T], np.array([0, 1, 2, 4])
        g, h, n, x = cells.sums(kept * (y - p)), cells.sums(kept * p * (1 - p)), len(cells.first), x[cells.first]
        plain = T.grow_by_ranks(cells, levels, cols, np.flatnonzero(h > 0), g, h, 3, 1.0, lambda r, g=g, h=h: float(g[r].sum() / (h[r].sum() + 1)))
        made, leaf = T.grow_levels(
            cells, levels, np.repeat(np.arange(3), n), np.tile(np.arange(n), 3), (np.tile(h, 3), np.tile(g, 3)), np.array([3, 2, 3]), lambda count, cols=cols: np.tile(cols, (count, 1)), lambda a, b: (a, b), lambda h, g, _: g / (h + 1), reg=1.0
        )
        first, second, third = made
        assert len(first.value) == len(third.value) == len(plain.value) > len(second.value)
        assert all(np.allclose(t.predict(x), plain.predict(x)) for t in (first, third)) and np.allclose(made.value[leaf].reshape(3, -1)[1], second.predict(x))
