from __future__ import annotations

import random
from itertools import groupby

import pytest
from labelscope.operators import audit, features, quality, rolling, runs
from pyspark.sql import functions as F


def test_runs_equal_itertools(spark):
    rng = random.Random(1)
    codes = [rng.choice([0, 1, 1, 1, None]) for _ in range(300)]
    df = spark.createDataFrame([("S2", i, c) for i, c in enumerate(codes)], "participant_id string, t int, code int").repartition(4)
    got = [(r["code"], r["start_idx"], r["end_idx"], r["n_samples"]) for r in runs.contiguous_runs(df, ["participant_id"], ["t"]).orderBy("start_idx").collect()]
    want, at = [], 0
    for c, g in groupby(codes):
        n = len(list(g))
        want.append((c, at, at + n, n))
        at += n
    assert got == want


def test_code_summary_orders_run_durations(spark):
    df = spark.createDataFrame([("S2", 1, 0, 4, 4), ("S2", 0, 4, 6, 2), ("S2", 1, 6, 16, 10)], "participant_id string, code int, start_idx long, end_idx long, n_samples long")
    got = {r["code"]: r for r in runs.code_summary(df, ["participant_id"], 2.0).collect()}
    assert got[1]["run_durations_s"] == [2.0, 5.0] and got[1]["n_runs"] == 2 and got[0]["duration_s"] == 1.0


def test_overlap_keeps_unmatched_and_the_earlier_of_ties(spark):
    schedule = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 50.0, 60.0), (2, 2, 0.0, 10.0)], "code int, position int, start_s double, end_s double")
    r = spark.createDataFrame([(1, 6.0, 14.0), (1, -4.0, 4.0), (1, 60.0, 70.0), (2, 2.0, 9.0), (2, 1.0, 3.0)], "code int, start_s double, end_s double")
    got = {x["position"]: x for x in runs.overlap_argmax(schedule, r, ["code"]).collect()}
    assert got[0]["run_start_s"] == -4.0 and got[0]["overlap_s"] == 4.0 and got[0]["start_offset_s"] == -4.0
    assert got[1]["matched"] is False and got[1]["run_start_s"] is None and got[2]["overlap_s"] == 7.0


def test_overlaps_do_not_depend_on_bins(spark):
    rng = random.Random(7)
    span = lambda: (lambda a: (a, a + rng.choice([0.0, 1.0, 3.0, 40.0]) * rng.random()))(rng.uniform(-20, 20))
    schedule = [(k % 3, k, *span()) for k in range(60)] + [(1, 60, None, 5.0), (None, 61, 0.0, 9.0), (1, 62, 5.0, 1.0)]
    found = [(k % 4, *span()) for k in range(80)] + [(1, 2.0, None), (None, 0.0, 9.0)]
    s, r = spark.createDataFrame(schedule, "k int, position int, start_s double, end_s double"), spark.createDataFrame(found, "k int, start_s double, end_s double")
    want = {}
    for k, position, a, b in schedule:
        over = [(min(b, d) - max(a, c), -c) for kk, c, d in found if None not in (k, a, b, c, d) and kk == k and a <= b and d > a and c < b]
        want[position] = (round(max(over)[0], 9), -max(over)[1]) if over else (None, None)
    for width in (None, 0.7, 1000.0):
        got = {x["position"]: (round(x["overlap_s"], 9) if x["matched"] else None, x["run_start_s"]) for x in runs.overlap_argmax(s, r, ["k"], width).collect()}
        assert got == want


def test_a_key_with_many_rows_makes_few_pairs(spark):
    n = 40_000
    s = spark.range(n).selectExpr("1 AS k", "id AS position", "CAST(id * 10 AS double) AS start_s", "CAST(id * 10 + 10 AS double) AS end_s")
    r = spark.range(n).selectExpr("1 AS k", "CAST(id * 10 + 4 AS double) AS start_s", "CAST(id * 10 + 14 AS double) AS end_s")
    got = runs.overlap_argmax(s, r, ["k"])
    assert got.filter("matched AND overlap_s = 6").count() == n


def test_alignment_finds_one_offset_and_refuses_periodic_data(spark):
    rng = random.Random(2)
    raw = [("S2", i, rng.randint(-64, 63), rng.randint(-64, 63)) for i in range(200)] + [("S3", i, i % 10, 0) for i in range(200)]
    part = [("S2", i, raw[i + 37][2], raw[i + 37][3]) for i in range(100)] + [("S3", i, i % 10, 0) for i in range(50)] + [("S4", 0, 1, 1)]
    schema = "participant_id string, i long, x int, y int"
    got = {r["participant_id"]: (r["matched"], r["offset"]) for r in runs.align_exact(spark.createDataFrame(raw, schema), spark.createDataFrame(part, schema), ["x", "y"], ["participant_id"]).collect()}
    assert got == {"S2": (True, 37), "S3": (False, None), "S4": (False, None)}


def test_alignment_within_a_tolerance(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(300)]
    schema = "participant_id string, i long, value double"
    raw = spark.createDataFrame([("S2", i, v) for i, v in enumerate(values)], schema)
    near = spark.createDataFrame([("S2", i, values[i + 21] + 9e-10) for i in range(120)], schema)
    far = spark.createDataFrame([("S2", i, values[i + 21] + 3e-9) for i in range(120)], schema)
    assert tuple(runs.align_within(raw, near, ["participant_id"]).first()) == ("S2", True, 21)
    assert tuple(runs.align_within(raw, far, ["participant_id"]).first()) == ("S2", False, None)


def test_runs_do_not_depend_on_blocks(spark):
    rng = random.Random(6)
    codes = {f"S{k}": [rng.choice([0, 1, None]) if k % 2 else k for _ in range(rng.randrange(1, 60))] for k in range(12)} | {None: [1, 1, 2], "hot": [i // 700 % 2 for i in range(3000)]}
    rows = [(who, t, c) for who, series in codes.items() for t, c in enumerate(series)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "who string, t long, code int")
    want = set()
    for who, series in codes.items():
        at = 0
        for k, (code, group) in enumerate(groupby(series)):
            n = len(list(group))
            want.add((who, k, code, at, at + n, n))
            at += n
    for block in (1, 2, 1000):
        got = runs.contiguous_runs(df, ["who"], ["t"], block=block)
        assert {tuple(r) for r in got.collect()} == want and got.columns == ["who", "run_index", "code", "start_idx", "end_idx", "n_samples"]
    assert runs.contiguous_runs(df.limit(0), ["who"], ["t"]).count() == 0


def unique_offset(raw, part, same):
    found = [o for o in range(len(raw) - len(part) + 1) if all(same(raw[o + k], v) for k, v in enumerate(part))]
    return (len(found) == 1, found[0] if len(found) == 1 else None)


def test_exact_alignment_equals_all_offsets(spark):
    rng = random.Random(4)
    cases = []
    for k in range(60):
        raw = [rng.choice([0.0, 1.0, None]) if rng.random() < 0.1 else float(rng.randrange(2 if k % 2 else 5)) for _ in range(rng.randrange(1, 30))]
        at, size = rng.randrange(len(raw)), rng.randrange(1, 9)
        part = raw[at : at + size] if k % 3 else [float(rng.randrange(3)) for _ in range(size)]
        cases.append((raw, [-0.0 if v == 0 else v for v in part]))
    rows = lambda j: [(k, i, v) for k, c in enumerate(cases) for i, v in enumerate(c[j])]
    schema = "k int, i long, value double"
    raw, part = spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema)
    equal = lambda a, b: a is not None and a == b
    want = {k: unique_offset(a, b, equal) for k, (a, b) in enumerate(cases)}
    assert {r["k"]: (r["matched"], r["offset"]) for r in runs.align_exact(raw, part, ["value"], ["k"]).collect()} == want
    assert {r["k"]: (r["matched"], r["offset"]) for r in runs.align_within(raw, part, ["k"]).collect()} == want


def test_alignment_within_equals_all_offsets_near_bucket_edges(spark):
    rng = random.Random(5)
    tolerance, width = 1e-3, 1e-3 * runs.BUCKET / runs.GRIDS
    cases = []
    for k in range(40):
        raw = [rng.randrange(-3, 3) * width + rng.choice([0, 0.9e-3, -0.9e-3, 2e-3]) * rng.choice([0, 1]) for _ in range(rng.randrange(3, 25))]
        at = rng.randrange(len(raw))
        part = [v + rng.choice([-1, 0, 1]) * rng.choice([0.5e-3, 0.99e-3]) for v in raw[at : at + rng.randrange(1, 6)]]
        cases.append((raw, part if k % 9 else [*part, None]))
    rows = lambda j: [(k, i, v) for k, c in enumerate(cases) for i, v in enumerate(c[j])]
    schema = "k int, i long, value double"
    want = {k: unique_offset(a, b, lambda x, y: y is not None and abs(x - y) <= tolerance) for k, (a, b) in enumerate(cases)}
    got = runs.align_within(spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema), ["k"], tolerance)
    assert {r["k"]: (r["matched"], r["offset"]) for r in got.collect()} == want


def test_flat_and_periodic_recordings_make_no_more_rows_than_they_have(spark):
    n = 60_000
    raw = spark.range(n).selectExpr("'S1' AS k", "id AS i", "CAST(id % 7 AS double) AS value").unionByName(spark.range(n).selectExpr("'S2' AS k", "id AS i", "1.5D AS value"))
    part = raw.filter("i < 20000")
    offers = rolling.occurrences(rolling.prefixes(raw.selectExpr("k", "i", "CAST(value * 2 AS long) AS token"), ["k"]), rolling.fingerprint(part.selectExpr("k", "i", "CAST(value * 2 AS long) AS token"), ["k"]), ["k"])
    counts = {r["k"]: r["count"] for r in offers.groupBy("k").count().collect()}
    assert counts == {"S1": 40_000 // 7 + 1, "S2": 40_001}
    for got in (runs.align_exact(raw, part, ["value"], ["k"]), runs.align_within(raw, part, ["k"])):
        assert {(r["k"], r["matched"], r["offset"]) for r in got.collect()} == {("S1", False, None), ("S2", False, None)}


def test_prefix_sums_do_not_depend_on_blocks(spark):
    rows = spark.range(500).selectExpr("id % 3 AS k", "id DIV 3 AS i", "xxhash64(id) AS token")
    want = rolling.prefixes(rows, ["k"], 1000).collect()
    for block in (1, 2, 7):
        assert sorted(rolling.prefixes(rows, ["k"], block).collect()) == sorted(want)
    mine = sorted((r["i"], r["token"]) for r in rows.filter("k = 1").collect())
    total = sum(t % rolling.PRIMES[0] * pow(rolling.BASE, i, rolling.PRIMES[0]) for i, t in mine) % rolling.PRIMES[0]
    assert max((r["i"], r["h0"]) for r in want if r["k"] == 1)[1] == total


def test_constant_is_per_channel(spark):
    still = [(0, 0.0, 0.0, 64.0)] * 20 + [(1, float(i), 0.0, 64.0) for i in range(20)] + [(2, None, float("nan"), None)] * 3
    df = spark.createDataFrame(still, "window_index int, x double, y double, z double")
    got = {r["window_index"]: r for r in quality.modality_flags(df, ["window_index"], ["x", "y", "z"], 20, "acc").collect()}
    assert got[0]["q_acc_constant"] and not got[1]["q_acc_constant"] and got[2]["q_acc_constant"] and got[0]["q_acc_count_ok"] and got[2]["q_acc_finite_fraction"] == 0
    grid = spark.createDataFrame([(0,), (7,)], "window_index int")
    empty = {r["window_index"]: r for r in quality.complete_flags(grid, quality.modality_flags(df, ["window_index"], ["x", "y", "z"], 20, "acc"), ["window_index"], "acc").collect()}[7]
    assert (empty["q_acc_n_samples"], empty["q_acc_finite_fraction"], empty["q_acc_constant"]) == (0, 0.0, False)


def test_range_flags(spark):
    df = spark.createDataFrame([(1.0, 127.0), (None, float("nan")), (50.0, -3.0)], "t double, c double")
    r = df.agg(quality.any_near_rail(["c"]).alias("rail"), quality.any_below(F.col("t"), 0.01).alias("low"), quality.any_outside(F.col("t"), 20, 45).alias("out")).first()
    assert (r["rail"], r["low"], r["out"]) == (True, False, True)
    assert tuple(df.filter("false").agg(quality.any_near_rail(["c"])).first()) == (False,)


def test_slope_and_differences_stay_inside_windows(spark):
    df = spark.createDataFrame([(w, i, 3.0 + 2.0 * (i / 4) + 100 * w) for w in range(2) for i in range(240)], "window_index int, i int, value double")
    got = df.groupBy("window_index").agg(features.slope(F.col("value"), F.col("i") / 4).alias("s")).collect()
    assert all(abs(r["s"] - 2.0) < 1e-9 for r in got)
    d = features.difference(df, ["window_index"], ["i"], "value").groupBy("window_index").agg(F.max("diff").alias("m"), F.count("diff").alias("n")).collect()
    assert all(abs(r["m"] - 0.5) < 1e-9 and r["n"] == 239 for r in d)


def test_windows_without_events_have_zero_and_null(spark):
    w = spark.createDataFrame([(0,), (1,)], "window_index int")
    got = {r["window_index"]: r for r in features.event_features(w, spark.createDataFrame([(0, 0.5), (0, 1.5)], "window_index int, a double"), ["window_index"], "a", "eda_scr").collect()}
    assert (got[0]["eda_scr_count"], got[0]["eda_scr_amp_sum"], got[0]["eda_scr_amp_max"]) == (2, 2.0, 1.5)
    assert (got[1]["eda_scr_count"], got[1]["eda_scr_amp_sum"], got[1]["eda_scr_amp_mean"]) == (0, 0.0, None)


@pytest.mark.parametrize(("n", "available"), [(61, True), (10, False)])
def test_heart_rate_needs_enough_beats(spark, n, available):
    w = spark.createDataFrame([(0,), (1,)], "window_index int")
    beats = spark.createDataFrame([(0, float(i)) for i in range(n)], "window_index int, t double")
    got = {r["window_index"]: r for r in features.interbeat_features(w, beats, ["window_index"], 60.0).collect()}
    assert got[0]["q_bvp_hr_available"] is available and got[0]["hr_mean"] == (60.0 if available else None) and got[0]["bvp_valid_ibi_count"] == n - 1
    assert got[1]["bvp_beat_count"] == 0 and got[1]["q_bvp_hr_available"] is False


def test_an_error_nulls_its_family_and_later_ones(spark):
    df = spark.createDataFrame([(None, 1, 2, 3), (1, 1, 2, 3), (0, 1, 2, 3)], "error_family int, a int, b int, c int")
    assert [tuple(r)[1:] for r in features.null_after_error(df, [["a"], ["b"], ["c"]]).collect()] == [(1, 2, 3), (1, None, None), (None, None, None)]


def test_grades(spark):
    df = spark.createDataFrame([(["x_missing"],), (["missing_condition_codes"],), (["clock"],), ([],), (["acc_channels_2"],)], "flags array<string>")
    assert [r[0] for r in df.select(audit.grade(F.col("flags"))).collect()] == ["unusable", "questionable", "questionable", "apparently_usable", "unusable"]


def test_flat_tables(spark):
    df = spark.sql("select 'S2' participant_id, 'ok' grade, array('a', 'b') flags, array(named_struct('name', 'EDA', 'n', 4)) signals, array(named_struct('code', 1)) labels, array(named_struct('code', 1, 's', 0), named_struct('code', 2, 's', 9)) runs")
    t = audit.flat_tables(df)
    assert t["participants"].first()["flags"] == "a;b" and t["runs"].count() == 2 and t["signals"].columns == ["participant_id", "position", "name", "n"]


def test_schedule_flags(spark):
    df = spark.createDataFrame([("S2", True, 1.0), ("S2", True, 4.0), ("S3", False, None), ("S3", True, 2.0)], "participant_id string, matched boolean, start_offset_s double")
    got = {r["participant_id"]: (r["n_no_matching_run"], r["offset_spread_flag"]) for r in audit.schedule_flags(df, ["participant_id"]).collect()}
    assert got == {"S2": (0, True), "S3": (1, False)}
