from __future__ import annotations

import math
import random

import pytest
from labelscope.operators import metrics as M
from labelscope.operators import ranked
from pyspark.sql import functions as F


def brute(rows, key, order, value):
    out = []
    for r in rows:
        group = [o for o in rows if o[key] == r[key]]
        before = sum(o[value] for o in group if (o[order] is not None, o[order] or 0) < (r[order] is not None, r[order] or 0))
        out.append((*r, before, sum(o[value] for o in group)))
    return out


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_running_totals_equal_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["a", "a", "a", "b", None]), x, rng.randint(0, 5), f"w{x}") for x in rng.sample(range(1000), 120)] + [("a", None, 3, "n"), (None, None, 2, None)]
    df = spark.createDataFrame(rows, "g string, x int, v int, _row string").repartition(5)
    got = ranked.running_totals(df, ["g"], {"x": F.col("x")}, {"v": F.col("v")}, block)
    assert got.columns == ["g", "x", "v", "_row", "v_before", "v_total"]
    key = lambda r: (str(r[0]), -1 if r[1] is None else r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, 0, 1, 2), key=key)


def test_rows_of_equal_order_follow_one_another(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") % 2).alias("x"))
    got = ranked.running_totals(df, ["g"], {"x": F.col("x")}, {"n": F.lit(1)}, 64)
    assert sorted(r["n_before"] for r in got.filter("x = 0").collect()) == list(range(2500))
    assert sorted(r["n_before"] for r in got.filter("x = 1").collect()) == list(range(2500, 5000))
    assert got.filter("n_total <> 5000").count() == 0
    assert ranked.running_totals(df.limit(0), ["g"], {"x": F.col("x")}, {"n": F.lit(1)}).count() == 0


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_ranks_and_curves_by_blocks_of_any_size(spark, monkeypatch, block):
    # one score holds a third of a group, two scores are no number or null
    monkeypatch.setattr(ranked.running_totals, "__defaults__", (block,))
    rng = random.Random(9)
    score = lambda: 0.5 if rng.random() < 1 / 3 else rng.choice([None, float("nan"), round(rng.random(), 2)]) if rng.random() < 0.1 else round(rng.random(), 2)
    rows = [(rng.choice("ab"), i, score(), rng.choice([0, 1, None]), rng.randint(0, 1)) for i in range(300)] + [("c", 999, 0.1, 1, 1)]
    df = spark.createDataFrame(rows, "g string, id int, p double, y int, hard int")
    place = lambda p: (0, 0) if p is None else (2, 0) if math.isnan(p) else (1, p)
    got = {r["id"]: (r["average_rank"], r["percentile_rank"]) for r in M.average_rank(df, ["g"], "p").collect()}
    assert len(got) == 301 and got[999] == (1.0, 0.0)
    for g, i, p, _, _ in rows[:300]:
        group = [place(r[2]) for r in rows if r[0] == g]
        rank = sum(o < place(p) for o in group) + (sum(o == place(p) for o in group) + 1) / 2
        assert got[i] == (rank, (rank - 1) / (len(group) - 1))
    known = [r for r in rows if r[2] is not None and not math.isnan(r[2])]
    kept = spark.createDataFrame(known, df.schema)
    curves = {r["g"]: r for r in M.ranking_metrics(kept, ["g"]).collect()}
    for g in "ab":
        ones, zeros = ([r[2] for r in known if r[0] == g and r[3] == y] for y in (1, 0))
        wins = sum((a > b) + (a == b) / 2 for a in ones for b in zeros)
        assert curves[g]["auroc"] == pytest.approx(wins / len(ones) / len(zeros), abs=1e-12)
        steps = sum(sum(o >= a for o in ones) / (sum(o >= a for o in ones) + sum(o >= a for o in zeros)) for a in ones)
        assert curves[g]["average_precision"] == pytest.approx(steps / len(ones), abs=1e-12)
    assert curves["c"]["auroc"] is None and curves["c"]["n1"] == 1
    for r in M.risk_coverage(kept, ["g"]).collect():
        group = [o for o in known if o[0] == r["g"] and o[3] is not None]
        above = [o for o in group if max(o[2], 1 - o[2]) >= r["confidence"]]
        assert (r["n_kept"], r["coverage"]) == (len(above), len(above) / len(group)) and r["error_rate"] == sum(o[3] != o[4] for o in above) / len(above)


def test_no_window_holds_a_group(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").alias("w"), (F.col("id") / 1000).alias("p"))
    plan = M.average_rank(df, ["g"], "p")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    # rows are in windows of a block; those of a whole group hold a row a block
    assert any("_at#" in line for line in windows) and all("_block#" in line for line in windows if "_at#" in line)
    assert not any("_o_" in line or "_row#" in line.split("windowspecdefinition")[1] for line in windows)
