from __future__ import annotations

import numpy as np
import pytest
from labelscope.functions import signal as G
from labelscope.operators import block_signals, decompose


def gain(sections, f, rate):
    z = np.exp(2j * np.pi * f / rate)
    return abs(np.prod([np.polyval(s[:3], z) / np.polyval(s[3:], z) for s in sections]))


@pytest.mark.parametrize(("order", "cut", "rate"), [(2, 0.05, 4.0), (3, 1.0, 10.0), (5, 2.0, 50.0)])
def test_low_pass_response(order, cut, rate):
    s = G.butterworth(order, cut, rate)
    assert abs(gain(s, 0, rate) - 1) < 1e-9 and abs(gain(s, cut, rate) - np.sqrt(0.5)) < 1e-9 and gain(s, 0.45 * rate, rate) < 0.05
    warped = np.tan(np.pi * 1.7 * cut / rate) / np.tan(np.pi * cut / rate)
    assert abs(gain(s, 1.7 * cut, rate) - 1 / np.sqrt(1 + warped ** (2 * order))) < 1e-9


def test_band_pass_response():
    s = G.butterworth(3, (0.5, 8.0), 64.0)
    assert s.shape == (3, 6) and all(abs(gain(s, f, 64.0) - np.sqrt(0.5)) < 1e-9 for f in (0.5, 8.0)) and gain(s, 0.0, 64.0) < 1e-9 and abs(gain(s, 2.0, 64.0) - 1) < 1e-3
    assert all(abs(r) < 1 for row in s for r in np.roots(row[3:]))


def test_filter_has_no_phase_and_keeps_constants():
    s = G.butterworth(2, 0.05, 4.0)
    assert np.allclose(G.filter_both_ways(s, np.full(400, 3.5)), 3.5)
    t = np.arange(4000) / 4.0
    slow = np.sin(2 * np.pi * 0.005 * t)
    mid = slice(400, -400)
    assert np.abs(G.filter_both_ways(s, slow) - slow)[mid].max() < 0.01
    x = np.random.default_rng(0).normal(size=500)
    assert np.allclose(G.filter_both_ways(s, x)[150:-150], G.filter_both_ways(s, x[::-1])[::-1][150:-150], atol=1e-3)
    with pytest.raises(ValueError):
        G.filter_both_ways(s, np.zeros(5))


def test_peaks_by_hand():
    x = np.array([0, 1, 0, 3, 3, 0, 2, 1, 2.5, 0, 5])
    assert G.local_maxima(x).tolist() == [1, 3, 6, 8]
    assert G.prominences(x, np.array([1, 3, 6, 8])).tolist() == [1.0, 3.0, 1.0, 2.5]
    at, height = G.find_peaks(x, 3, 1.5)
    assert at.tolist() == [3, 8] and height.tolist() == [3.0, 2.5]
    assert G.find_peaks(np.array([1.0, 1.0]), 1, 0)[0].tolist() == []


def test_beats_of_a_pulse():
    t = np.arange(64 * 60) / 64.0
    at, _ = G.detect_beats(np.sin(2 * np.pi * 1.2 * t) ** 3 + 0.1 * np.sin(2 * np.pi * 0.1 * t), 64.0)
    assert abs(len(at) - 72) <= 1 and np.abs(np.diff(at) / 64.0 - 1 / 1.2).max() < 0.05


def test_decomposition_and_failures_as_status(spark):
    t = np.arange(4 * 300) / 4.0
    eda = 2 + 0.001 * t + sum(0.3 * np.exp(-((t - c) ** 2) / 8) for c in (60, 120, 180, 240))
    rows = [("S2", i, float(v)) for i, v in enumerate(eda)] + [("S3", i, 1.0) for i in range(5)] + [("S4", i, float("nan") if i == 9 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "participant_id string, sample_index long, value double").repartition(4)
    got = decompose.eda_decomposition(df, 4.0).toPandas()
    s2 = got[got.participant_id == "S2"].sort_values("sample_index")
    assert s2.ok.all() and np.allclose(s2.tonic + s2.phasic, s2.value)
    assert s2[s2.event_amplitude > 0.1].sample_index.tolist() == [240, 480, 720, 960]
    for p in ("S3", "S4"):
        bad = got[got.participant_id == p]
        assert not bad.ok.any() and bad.tonic.isna().all() and (bad.error != "").all()
    peaks = decompose.pulse_peaks(df, 64.0).toPandas()
    assert peaks[peaks.participant_id == "S3"].sample_index.isna().all() and not peaks[peaks.participant_id == "S3"].ok.any()


def test_blocks_equal_the_sample_by_sample_recursion():
    x = np.random.default_rng(1).normal(size=1000)
    for section in np.vstack([G.butterworth(3, (0.5, 8.0), 64.0), G.butterworth(3, 1.0, 10.0)]):
        b0, b1, b2, _, a1, a2 = section
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = (b2 - a2 * gain) * x[0]
        z1 = (b1 - a1 * gain) * x[0] + z2
        want = []
        for v in x:
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            want.append(y)
        assert np.allclose(G._run(section, x, x[0]), want, atol=1e-10)


def recordings_of(rng):
    """Recordings with noise, pulses, a plateau, a ramp, one short and one not finite."""
    t = np.arange(3000) / 64.0
    pulse = np.sin(2 * np.pi * 1.2 * t) ** 3 + 0.2 * rng.normal(size=3000)
    ramp = np.linspace(0, 30, 2500) + np.sin(np.arange(2500) / 9)
    return {"noise": rng.normal(size=2200), "pulse": pulse, "ramp": ramp, "flat": np.concatenate([np.zeros(900), np.ones(900), pulse[:500]]), "still": np.full(800, 2.0), "short": np.zeros(6), "bad": np.append(pulse[:400], np.nan)}


@pytest.mark.parametrize(("chunk", "reach"), [(1, 3), (97, 8), (700, 64), (65_536, 64)])
def test_chunks_equal_the_whole_recording(spark, chunk, reach):
    series = recordings_of(np.random.default_rng(4))
    if chunk == 1:
        series = {k: v[:60] for k, v in series.items()}
    rows = [(k, 3 * i + 5, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "participant_id string, sample_index long, value double").repartition(5)
    keys = ["participant_id", "sample_index"]
    want = decompose.eda_of_whole_recordings(df, 4.0).toPandas().sort_values(keys).reset_index(drop=True)
    got = decompose.eda_decomposition(df, 4.0, chunk=chunk, reach=reach).toPandas().sort_values(keys).reset_index(drop=True)
    assert got[[*keys, "ok", "error"]].equals(want[[*keys, "ok", "error"]]) and (got["event_amplitude"].isna() == want["event_amplitude"].isna()).all()
    for c in ("tonic", "phasic", "event_amplitude"):
        assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=0, atol=1e-9, equal_nan=True)
    want, got = (f(df, 64.0, **more).toPandas().sort_values(keys).reset_index(drop=True) for f, more in ((decompose.beats_of_whole_recordings, {}), (decompose.pulse_peaks, {"chunk": chunk, "reach": reach})))
    assert got[[*keys, "ok", "error"]].astype(str).equals(want[[*keys, "ok", "error"]].astype(str))


def test_peaks_of_chunks_equal_those_of_the_whole_where_sure():
    rng = np.random.default_rng(5)
    sure = 0
    for k in range(300):
        y = np.round(np.cumsum(rng.normal(size=400)) if k % 2 else rng.normal(size=400), 1 if k % 3 else 6)
        apart = int(rng.integers(1, 12))
        at, height = G.find_peaks(y, apart, 0.0)
        step, more = int(rng.integers(1, 150)), int(rng.integers(2, 200))
        found, unsure = {}, False
        summaries = [(float(y[a : a + step].min()), *block_signals.climbs(y[a : a + step])) for a in range(0, 400, step)]
        behind = [(s[0], *block_signals.climbs(y[a : a + step][::-1])) for s, a in zip(summaries, range(0, 400, step), strict=True)]
        for c, a in enumerate(range(0, 400, step)):
            b = min(400, a + step)
            low, high = max(0, a - more), min(400, b + more)
            peaks, doubt = block_signals.chunk_peaks(y[low:high], a - low, b - low, low > 0, high < 400, apart)
            unsure |= doubt
            for p, v, left, left_done, right, right_done in peaks:
                left = left if left_done else block_signals._low_until_higher(v, left, (behind[j] for j in range(c - 1, -1, -1)))
                right = right if right_done else block_signals._low_until_higher(v, right, (summaries[j] for j in range(c + 1, len(summaries))))
                found[p + low] = v - max(left, right)
        if not unsure:
            sure += 1
            assert sorted(found) == at.tolist() and np.allclose([found[p] for p in at], height, atol=1e-12)
    assert sure > 60


def test_short_recordings_are_not_cut_into_chunks(spark, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("cut into chunks")

    monkeypatch.setattr(decompose.B, "placed", refuse)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # batches that end inside recordings
    try:
        rng = np.random.default_rng(8)
        made = {f"S{i}": np.round(np.cumsum(rng.normal(size=n)), 3) for i, n in enumerate((120, 3, 75, 200, 1))}
        made["S5"] = np.where(np.arange(60) == 30, np.nan, 1.0)
        df = spark.createDataFrame([(w, 10 + 2 * k, float(v)) for w, x in made.items() for k, v in enumerate(x)], "participant_id string, sample_index long, value double").repartition(3)
        got = {w: f.sort_values("sample_index") for w, f in decompose.pulse_peaks(df, 64.0).toPandas().groupby("participant_id")}
        parts = {w: f.sort_values("sample_index") for w, f in decompose.eda_decomposition(df, 4.0).toPandas().groupby("participant_id")}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got.keys() == parts.keys() == made.keys()
    for w, x in made.items():
        assert parts[w]["sample_index"].tolist() == [10 + 2 * k for k in range(len(x))]
        if w in ("S0", "S2", "S3"):
            assert got[w]["sample_index"].tolist() == [10 + 2 * int(k) for k in decompose.G.detect_beats(x, 64.0)[0]] and got[w]["ok"].all()
            tonic, _, at, height = decompose.G.decompose_eda(x, 4.0)
            assert (parts[w]["tonic"].to_numpy(float) == tonic).all() and parts[w]["event_amplitude"].dropna().tolist() == height.tolist()
        else:
            assert got[w]["sample_index"].isna().all() and len(got[w]) == 1 and not parts[w]["ok"].any() and parts[w]["tonic"].isna().all() and (parts[w]["error"] != "").all()


def test_hours_are_dealt_while_few_and_samples_are_not_written(spark, tmp_path, monkeypatch):
    from datetime import datetime, timedelta

    from labelscope.plans import recordings
    from labelscope.plans.tables import samples
    from pyspark.sql import functions as F

    start, rows = datetime(2024, 1, 1), []
    seconds = {1: [10, 20, 3_600, 40 * 3_600, 400_000], 2: [3_599], 3: [-7_000, -10], 4: [-9_000, -7_300], 5: [-5_000, 2 * 3_600, 700_000], 6: [None, 90_000], 7: [None], None: [5_000]}
    for user, at in seconds.items():
        rows += [(len(rows) + k, None if s is None else start + timedelta(seconds=s), user, "view", None if k == 2 else s and s / 7.0, None) for k, s in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    # as it was: all hours, and the sums joined to them
    spans = recordings.recordings(spark, str(tmp_path)).select("participant_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration_s") / 3600))).alias("sample_index"))
    got = samples(spark, str(tmp_path)).groupBy("participant_id", F.floor(F.col("sample_index") / 3600).alias("sample_index")).agg(F.sum("value").alias("_v"))
    want = spans.join(got, ["participant_id", "sample_index"], "left").select("participant_id", "sample_index", F.coalesce("_v", F.lit(0.0)).alias("value"))
    order = lambda df: sorted(map(tuple, df.filter("participant_id IS NOT NULL").collect()))
    hours = recordings.hourly(spark, str(tmp_path))
    assert order(hours) == order(want) and len(order(hours)) > 300

    written = []
    monkeypatch.setattr(decompose, "cut", lambda df, cut=decompose.cut: written.append(df.columns) or cut(df))
    dealt = decompose.eda_decomposition(hours, 4.0, dealt=True)
    assert written == [["participant_id"]]
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("Generate")[0] and "Join" not in plan
    keys = ["participant_id", "sample_index"]
    frames = [df.toPandas().sort_values(keys).reset_index(drop=True) for df in (dealt, decompose.eda_decomposition(hours.repartition(3), 4.0))]
    assert frames[0].equals(frames[1]) and frames[0]["ok"].any() and not frames[0]["ok"].all()


def test_rounding_of_many_is_that_of_few(spark):
    from labelscope.plans.registry import rounded

    rng = np.random.default_rng(3)
    ties = (rng.integers(-(10**9), 10**9, 20_000) + 0.5) / 1e6
    made = [ties, np.nextafter(ties, np.inf), np.nextafter(ties, -np.inf), ties + rng.normal(size=20_000) * 1e-9, rng.normal(size=20_000) * 10.0 ** rng.integers(-9, 18, 20_000)]
    values = [*np.concatenate(made).tolist(), 0.0, -0.0, -1e-9, 1e6, -999_999.9999995, 1e300, 5e-324, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    few, many = rounded(df), rounded(df, many=True)
    bits = lambda d: [r[0] for r in d.orderBy("k").selectExpr("hex(cast(v AS string))").collect()]
    assert bits(few) == bits(many)
