"""Loaders of wrist recordings: generated trees in both layouts against pandas, faults, labels that stay unknown."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from labelscope.sources import wrist_sessions as W
from pyspark.sql import functions as F

RATES = {"ACC": 32.0, "BVP": 64.0, "EDA": 4.0, "HR": 1.0, "TEMP": 4.0}


def signal_text(name: str, rng: np.random.Generator, start: float, seconds: int) -> str:
    if name == "IBI":
        times = np.cumsum(rng.uniform(0.5, 1.2, seconds))
        return f"{start}, IBI\n" + "\n".join(f"{t:.6f},{d:.6f}" for t, d in zip(times, rng.uniform(0.5, 1.2, seconds), strict=True)) + "\n"
    width, rate = W.SIGNALS[name], RATES[name]
    values = rng.integers(-64, 64, (int(rate * seconds), width)) if name == "ACC" else np.round(rng.normal(size=(int(rate * seconds), width)), 6)
    head = ", ".join([f"{start:.6f}"] * width) + "\n" + ", ".join([f"{rate:.6f}"] * width) + "\n"
    return head + "\n".join(",".join(map(str, row)) for row in values) + "\n"


def expected(name: str, text: str) -> pd.DataFrame:
    """The same by pandas."""
    start = float(text.split("\n", 1)[0].split(",")[0])
    if name == "IBI":
        rows = pd.read_csv(io.StringIO(text), skiprows=1, header=None)
        return pd.DataFrame({"unix_s": start + rows[0], "x": rows[1]})
    rows = pd.read_csv(io.StringIO(text), skiprows=2, header=None)
    rate = float(text.split("\n")[1].split(",")[0])
    return pd.DataFrame({"unix_s": start + np.arange(len(rows)) / rate} | {axis: rows[k] for k, axis in enumerate("xyz") if k in rows})


@pytest.fixture(scope="module")
def trees(tmp_path_factory):
    """Both layouts, with the text of every signal by (participant, session, signal)."""
    rng, root = np.random.default_rng(3), tmp_path_factory.mktemp("wrist")
    texts = {"hospital": {}, "protocol": {}}
    for who, shifts in (("5C", 2), ("E4", 1)):
        for k in range(shifts):
            session = f"{who}_{1586886626 + 40000 * k}"
            (root / "hospital" / who).mkdir(parents=True, exist_ok=True)
            with zipfile.ZipFile(root / "hospital" / who / f"{session}.zip", "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("info.txt", "text")
                archive.writestr("tags.csv", "1586886700.0\n")
                for name in W.SIGNALS:
                    texts["hospital"][who, session, name] = signal_text(name, rng, 1586886626.0 + 40000 * k, 20)
                    archive.writestr(f"{name}.csv", texts["hospital"][who, session, name])
    for who in ("S01", "S12"):
        (root / "protocol" / who).mkdir(parents=True)
        (root / "protocol" / who / f"tags_{who}.csv").write_text("1.0\n")
        for name in W.SIGNALS:
            texts["protocol"][who, who, name] = signal_text(name, rng, 1644226137.0, 15)
            (root / "protocol" / who / f"{name}.csv").write_text(texts["protocol"][who, who, name])
    return root, texts


@pytest.mark.parametrize(("kind", "layout"), [("hospital", W.HOSPITAL), ("protocol", W.PROTOCOL)])
def test_both_layouts_equal_pandas(spark, trees, kind, layout):
    root, texts = trees
    got = W.session_samples(W.session_files(spark, f"{root}/{kind}", layout), layout).toPandas()
    assert got["fault"].isna().all()
    groups = {key: g.sort_values("sample_index") for key, g in got.groupby(["participant_id", "session_id", "signal"])}
    assert set(groups) == set(texts[kind])
    for key, text in texts[kind].items():
        want, have = expected(key[2], text), groups[key]
        assert have["sample_index"].tolist() == list(range(len(want)))
        for column in want:
            assert np.allclose(have[column].to_numpy(float), want[column].to_numpy(float), rtol=0, atol=1e-9)
        assert set(have["rate_hz"].dropna()) == ({RATES[key[2]]} if key[2] in RATES else set())


def test_participants_are_chosen_before_reading(spark, trees):
    root, _ = trees
    files = W.session_files(spark, f"{root}/hospital", W.HOSPITAL, ["5C"])
    assert len(files.inputFiles()) == 2 and all("/5C/" in f for f in files.inputFiles())


def test_faulty_files_are_rows_with_their_fault(spark, tmp_path):
    (tmp_path / "A1").mkdir()
    (tmp_path / "A1" / "broken.zip").write_bytes(b"PK\x03\x04 no archive")
    with zipfile.ZipFile(tmp_path / "A1" / "odd.zip", "w") as archive:
        for name, text in {"EDA": "", "ACC": "1,1,1\n32,32,32\n1,2\n", "BVP": "x\n64\n1\n", "TEMP": "5\n0\n1\n", "HR": "5\n1\n", "IBI": "5, IBI\n"}.items():
            archive.writestr(f"{name}.csv", text)
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("EDA.csv", "5\n4\n" + "1.5\n" * 5000)
    octets = bytearray(good.getvalue())
    octets[60:80] = b"\xff" * 20
    (tmp_path / "A1" / "deflate.zip").write_bytes(bytes(octets))
    rows = W.session_samples(W.session_files(spark, str(tmp_path), W.HOSPITAL), W.HOSPITAL).collect()
    assert {(r["session_id"], r["signal"]) for r in rows if r["fault"]} == {("broken", None), ("deflate", None), ("odd", "EDA"), ("odd", "ACC"), ("odd", "BVP"), ("odd", "TEMP")}
    assert not [r for r in rows if not r["fault"]]  # HR and IBI are right and have no rows


def test_survey_answers_outside_the_classes_are_unknown(spark):
    rows = [("5C", "2020-04-14 20:00:00", "2020-04-14 20:30:00", "2"), ("5C", "2020-04-14 21:00:00", "2020-04-14 21:30:00", "0"), ("5C", "2020-04-14 22:00:00", "2020-04-14 22:30:00", "na"),
            ("5C", "2020-04-15 02:00:00", "2020-04-15 01:00:00", "2"), ("5C", "soon", None, "2"), ("5C", "2020-04-14 21:10:00", "2020-04-14 21:50:00", "2")]
    events = W.survey_events(spark.createDataFrame(rows, "participant string, start string, end string, level string"), {"0": 0, "2": 1}, "America/Chicago")
    zero = 1586912400.0  # 20:00 in that zone
    got = events.orderBy("start_unix").collect()
    assert [(r["start_unix"], r["y"]) for r in got] == [(None, 1), (None, 1), (zero, 1), (zero + 3600, 0), (zero + 4200, 1), (zero + 7200, None)]
    spans = [(0, 60), (1740, 1800), (1770, 1830), (3600, 3660), (4200, 4260), (5400, 5460), (7200, 7260), (100000, 100060)]
    grid = spark.createDataFrame([("5C", zero + a, zero + b, k) for k, (a, b) in enumerate(spans)] + [("E4", zero, zero + 60, 99)], "participant_id string, start_unix double, end_unix double, k int")
    labels = {r["k"]: (r["y"], r["n_events"]) for r in W.label_windows(grid, events).collect()}
    assert labels == {0: (1, 1), 1: (1, 1), 2: (None, 0), 3: (0, 1), 4: (None, 2), 5: (1, 1), 6: (None, 1), 7: (None, 0), 99: (None, 0)}


def test_long_events_label_windows_of_every_bin(spark):
    rng = np.random.default_rng(4)
    events = [("A", float(s), float(s + rng.integers(1, 9000)), int(rng.integers(2))) for s in rng.integers(0, 50000, 60)]
    grid = [("A", float(60 * k), float(60 * k + 60)) for k in range(900)]
    got = W.label_windows(spark.createDataFrame(grid, "participant_id string, start_unix double, end_unix double"), spark.createDataFrame(events, "participant_id string, start_unix double, end_unix double, y int"), 500.0)
    for r in got.collect():
        held = [e for e in events if e[1] <= r["start_unix"] and r["end_unix"] <= e[2]]
        assert r["n_events"] == len(held) and r["y"] == (held[0][3] if held and len({e[3] for e in held}) == 1 else None)


def test_task_labels_and_empty_folder(spark, tmp_path):
    (tmp_path / "all.csv").write_text("Participant,HR,respr,Time(sec),Label\n1,70,12,0,0\n12,80,13,1.5,1\n")
    assert [tuple(r) for r in W.task_labels(spark, f"{tmp_path}/all.csv").orderBy("second").collect()] == [("S01", 0.0, 0), ("S12", 1.5, 1)]
    (tmp_path / "S1").mkdir()
    (tmp_path / "S1" / "notes.csv").write_text("1\n")
    files = W.session_files(spark, str(tmp_path), W.PROTOCOL)
    assert W.session_samples(files, W.PROTOCOL).count() == 0 and W.session_samples(files.limit(0), W.PROTOCOL).agg(F.count("*")).first()[0] == 0
