from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from labelscope.functions import scalars as S
from labelscope.operators import windows as W
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_window_counts_and_tails(spark):
    rows = spark.createDataFrame([(6079.0,), (59.9,), (60.0,), (5238.0,), (0.0,), (None,)], "d double")
    got = [tuple(r) for r in rows.select("d", S.window_count(F.col("d"), 60.0), S.window_tail(F.col("d"), 60.0)).collect()]
    assert got[0] == (6079.0, 101, 19.0) and got[1] == (59.9, 0, 59.9) and got[2] == (60.0, 1, 0.0) and got[3][1:] == (87, 18.0) and got[4] == (0.0, 0, 0.0) and got[5][1] is None


def test_grid_has_ids_edges_and_no_row_for_short_recordings(spark):
    rec = spark.createDataFrame([("S2", 125.0), ("S3", 10.0)], "participant_id string, duration_s double")
    got = W.window_grid(rec, W.WindowSpec(60.0), {"acc": 32.0, "label": 700.0}, "wearable").orderBy("window_index").collect()
    assert [r["window_id"] for r in got] == ["wearable:S2:w00000", "wearable:S2:w00001"]
    assert (got[1]["acc_start_sample"], got[1]["acc_end_sample"], got[1]["label_end_sample"]) == (1920, 3840, 84000)


@pytest.mark.parametrize(("length", "step", "origin"), [(0, 1, 0), (1, 0, 0), (-1, 1, 0), (1, 1, 5)])
def test_bad_specs_are_refused(length, step, origin):
    with pytest.raises(ValueError):
        W.WindowSpec(length, step, origin)


def test_samples_go_half_open_and_the_tail_goes(spark):
    rec = spark.createDataFrame([("S2", 130.0)], "participant_id string, duration_s double")
    samples = spark.createDataFrame([("S2", i) for i in (0, 239, 240, 479, 480, 519)], "participant_id string, sample_index long")
    got = {r["sample_index"]: r["window_index"] for r in W.assign_windows(samples, rec, W.WindowSpec(60.0), 4.0).collect()}
    assert got == {0: 0, 239: 0, 240: 1, 479: 1}


def test_sliding_windows_overlap(spark):
    rec = spark.createDataFrame([("S2", 10.0)], "participant_id string, duration_s double")
    samples = spark.createDataFrame([("S2", i) for i in range(10)], "participant_id string, sample_index long")
    got = {(r["sample_index"], r["window_index"]) for r in W.assign_windows(samples, rec, W.WindowSpec(4.0, 2.0), 1.0).collect()}
    assert got == {(i, w) for w in range(4) for i in range(2 * w, 2 * w + 4)}


PATTERN = [(1, 60), (2, 60), (3, 60), (4, 60), (0, 60), (1, 30), (2, 30), (1, 59)]


def _labels(spark, pattern):
    codes = [c for c, n in pattern for _ in range(n)]
    return spark.createDataFrame([("S2", i // 60, c) for i, c in enumerate(codes)], "participant_id string, window_index int, code short")


def test_annotation(spark):
    grid = spark.createDataFrame([("S2", i) for i in range(8)], "participant_id string, window_index int")
    got = W.annotate(grid, _labels(spark, PATTERN), 60).orderBy("window_index").collect()
    assert [r["condition_name"] for r in got] == ["baseline", "stress", "amusement", "meditation", "transient", "mixed", "mixed", "mixed"]
    assert [r["analysis_label"] for r in got] == [0, 1, None, None, None, None, None, None]
    assert [r["n_label_samples"] for r in got] == [60] * 6 + [59, 0]
    assert got[5]["raw_label_codes_present"] == "1,2" and got[6]["ineligibility_reason"] == "mixed_label_codes" and got[7]["raw_label_codes_present"] == ""
    assert got[0]["ineligibility_reason"] == "" and got[3]["ineligibility_reason"].startswith("homogeneous_code_4")


def test_labels_never_move_the_grid(spark):
    rec = spark.createDataFrame([("S2", 480.0)], "participant_id string, duration_s double")
    grid = W.window_grid(rec, W.WindowSpec(60.0))
    ids = [sorted(r["window_id"] for r in W.annotate(grid, _labels(spark, p), 60).collect()) for p in (PATTERN, PATTERN[::-1], [])]
    assert ids[0] == ids[1] == ids[2] and len(ids[0]) == 8


def test_tokens_of_minutes_and_seconds(spark):
    for token, want in {"7.08": 428.0, "39.55": 2395.0, "50.3": 3030.0, "0": 0.0, "12": 720.0}.items():
        assert one(spark, S.minutes_seconds(F.lit(token)))[0] == want
    with pytest.raises(PySparkException):
        one(spark, S.minutes_seconds(F.lit("1.60")))


def test_samples_round_half_to_even(spark):
    assert [one(spark, S.sample_index(F.lit(s), F.lit(1.0)))[0] for s in (0.5, 1.5, 2.5)] == [0, 2, 2]


def test_known_seeds(spark):
    assert one(spark, S.child_seed(42, F.lit("model_fit:logistic:S2")))[0] == 1718432981
    assert one(spark, S.child_seed(42, F.lit("inner_split:S2")))[0] == 3511304750


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=12))
def test_seed_in_sql_is_the_one_in_python(stream):
    import hashlib

    from labelscope.operators.splits import seed_of

    assert seed_of(42, stream) == int.from_bytes(hashlib.sha256(f"42:{stream}".encode()).digest()[:4], "little")


def test_participants_sort_by_number(spark):
    df = spark.createDataFrame([("S10",), ("S2",), ("S1",)], "participant_id string")
    assert [r[0] for r in df.orderBy(S.participant_number(F.col("participant_id"))).collect()] == ["S1", "S2", "S10"]
    with pytest.raises(PySparkException):
        one(spark, S.participant_number(F.lit("X1")))


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r[0] for r in df.select(S.finite(F.col("v"))).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(S.present(F.col("v"))).collect()] == [1.0, None, None, None, None]


def test_usable_duration_is_the_shortest_stream(spark):
    df = spark.createDataFrame([("S2", 1280, 32.0), ("S2", 159, 4.0)], "participant_id string, n_samples long, rate_hz double")
    assert tuple(W.usable_duration(df).first()) == ("S2", 39.75, 0.25)
