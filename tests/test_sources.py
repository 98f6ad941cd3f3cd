from __future__ import annotations

import hashlib
import json
import pickle
import zipfile

import numpy as np
import pytest
from labelscope import cli
from labelscope import schema as C
from labelscope.plans import feature_table
from labelscope.sources import artifacts, config, integrity, release
from labelscope.streaming import windows as streaming
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

SECONDS = 185


def recording(subject="S2", seconds=SECONDS):
    rng = np.random.default_rng(0)
    t = lambda r: np.arange(seconds * r) / r
    label = np.zeros(seconds * 700, np.int32)
    label[: 60 * 700] = 1
    label[60 * 700 : 120 * 700] = 2
    eda = 2 + 0.05 * rng.random(seconds * 4) + 0.4 * np.exp(-((t(4) - 90) ** 2) / 6)
    wrist = {
        "ACC": rng.integers(-64, 64, (seconds * 32, 3)).astype(float), "BVP": (np.sin(2 * np.pi * 1.1 * t(64)) * 40 + rng.normal(size=seconds * 64))[:, None],
        "EDA": eda[:, None], "TEMP": (33 + 0.01 * t(4))[:, None],
    }
    return {"subject": subject, "label": label, "signal": {"wrist": wrist}}


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for p in ("S2", "S10"):
        (root / p).mkdir()
        with (root / p / f"{p}.pkl").open("wb") as file:
            pickle.dump(recording(p), file)
    (root / "readme.txt").write_text("x")
    (root / ".gitkeep").write_text("")
    (root / "docs").mkdir()
    (root / "docs" / "a.txt").write_text("y")
    return root


def test_snapshot_and_verify(spark, raw, tmp_path):
    base = tmp_path / "base.json"
    integrity.write_baseline(spark, str(raw), base)
    assert set(json.loads(base.read_text())["files"]) == {"S2/S2.pkl", "S10/S10.pkl", "readme.txt", "docs/a.txt"}
    assert integrity.changes_since(spark, str(raw), base) == {}
    with pytest.raises(integrity.BaselineExists):
        integrity.write_baseline(spark, str(raw), base)
    integrity.write_baseline(spark, str(raw), base, replace=True)
    (raw / "docs" / "a.txt").write_text("changed")
    (raw / "new.txt").write_text("n")
    (raw / "readme.txt").unlink()
    assert integrity.changes_since(spark, str(raw), base) == {"added": ["new.txt"], "removed": ["readme.txt"], "modified": ["docs/a.txt"]}
    assert integrity.main(["verify", str(raw), str(base)]) == 1 and integrity.main(["x"]) == 2 and integrity.main(["verify", str(raw), str(tmp_path / "none.json")]) == 2
    (raw / "docs" / "a.txt").write_text("y")
    (raw / "new.txt").unlink()
    (raw / "readme.txt").write_text("x")
    assert integrity.main(["verify", str(raw), str(base)]) == 0


def test_every_file_of_a_tree_counts(spark, tmp_path):
    root = tmp_path / "it's a tree"
    for name in (".gitkeep", "docs/.gitkeep", "docs/_x.txt", ".hidden", "_SUCCESS", "S2/.S2.pkl.crc", "empty.bin", "a b.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode() if name != "empty.bin" else b"")
    got = {r["path"]: (r["length"], r["sha256"]) for r in integrity.hash_tree(spark, str(root)).collect()}
    assert set(got) == {"docs/.gitkeep", "docs/_x.txt", ".hidden", "_SUCCESS", "S2/.S2.pkl.crc", "empty.bin", "a b.txt"}
    assert all(sha == hashlib.sha256((root / name).read_bytes()).hexdigest() and n == (root / name).stat().st_size for name, (n, sha) in got.items())
    base = integrity.write_baseline(spark, str(root), tmp_path / "b.json")
    (root / "docs" / "_x.txt").write_text("altered")
    (root / ".more").write_text("")
    (root / ".hidden").unlink()
    assert integrity.changes_since(spark, str(root), base) == {"added": [".more"], "modified": ["docs/_x.txt"], "removed": [".hidden"]}
    for bad in (tmp_path / "none", tmp_path / "empty"):
        (tmp_path / "empty").mkdir(exist_ok=True)
        with pytest.raises(FileNotFoundError):
            integrity.write_baseline(spark, str(bad), tmp_path / "c.json")
    assert not (tmp_path / "c.json").exists()


def test_large_files_are_hashed_in_blocks(tmp_path):
    large = tmp_path / "large.bin"
    with large.open("wb") as file:
        file.truncate((2 << 30) + 5)  # a sparse file of more than 2 GB
    with integrity.open_file(str(large)) as file:
        assert integrity.digest_of(file) == integrity.digest_of(Zeros((2 << 30) + 5))
    with integrity.open_file(f"file:{large}") as file:
        assert len(file.read(10)) == 10


class Zeros:
    def __init__(self, left):
        self.left, self.block = left, bytes(1 << 20)

    def read(self, n):
        take = min(n, self.left, len(self.block))
        self.left -= take
        return self.block[:take]


def test_release_is_verified_before_it_is_read(spark, raw, tmp_path):
    base = integrity.write_baseline(spark, str(raw), tmp_path / "b.json")
    opened = release.VerifiedRelease.open(spark, raw, base)
    assert opened.n_files == 4 and set(release.load_recording(opened, "S2")) == {"ACC", "BVP", "EDA", "TEMP", "label"}
    with pytest.raises(release.ReleaseError):
        release.VerifiedRelease(raw, {}, None)
    with pytest.raises(release.ReleaseError):
        opened.verified_path("../x")
    content = (raw / "S2" / "S2.pkl").read_bytes()
    (raw / "S2" / "S2.pkl").write_bytes(content + b" ")
    with pytest.raises(release.ReleaseError):
        release.load_recording(opened, "S2")
    with pytest.raises(release.ReleaseError):
        release.VerifiedRelease.open(spark, raw, base)
    (raw / "S2" / "S2.pkl").write_bytes(content)


def broken(**change):
    d = recording(seconds=20)
    for k, v in change.items():
        if k in d:
            d[k] = v
        else:
            d["signal"]["wrist"][k] = v(d["signal"]["wrist"][k]) if callable(v) else v
    return d


@pytest.mark.parametrize(
    "data",
    [
        {}, broken(subject="S9"), broken(ACC=lambda x: x[:, :2]), broken(EDA=lambda x: np.where(np.arange(len(x))[:, None] == 3, np.nan, x)), broken(BVP=lambda x: x[: len(x) // 2]),
        broken(TEMP=lambda x: x.astype(object)), broken(label=np.full(20 * 700, 9)), broken(label=np.full(20 * 700, 1.5)), broken(label=np.zeros((20 * 700, 2))), broken(EDA=lambda x: x[:0]),
    ],
)
def test_faulty_recordings_are_refused(data):
    with pytest.raises(release.ReleaseError):
        release.validate_recording(data, "S2")


def test_participants_and_expected_files(spark, raw):
    paths = integrity.hash_tree(spark, str(raw))
    assert [r[0] for r in release.participants(paths).collect()] == ["S2", "S10"]
    got = {(r["participant_id"], r["file"]): r["present"] for r in release.expected_files(paths).collect()}
    assert len(got) == 10 and got["S2", "S2.pkl"] and not got["S2", "S2_quest.csv"]


def test_schedule(spark):
    lines = ["# Subj;S2", "# ORDER;Base;TSST;Medi 1;fRead;Fun;;", "# START;7.08;39.55;70.19;81.2;93.38;;", "# END;26.32;50.3;77.1;82.1;100.15;;"]
    df = spark.createDataFrame([("S2", v) for v in lines], "participant_id string, value string")
    got = [(r["condition"], r["expected_code"], r["start_s"], r["end_s"]) for r in release.parse_schedule(df).orderBy("position").collect()]
    assert got == [("Base", 1, 428.0, 1592.0), ("TSST", 2, 2395.0, 3030.0), ("Medi 1", 4, 4219.0, 4630.0), ("Fun", 3, 5618.0, 6015.0)]
    for bad in (lines[:2] + ["# START;1.0"] + lines[3:], [lines[0], "# ORDER;What;", "# START;1.0;", "# END;2.0;"]):
        with pytest.raises(PySparkException):
            release.parse_schedule(spark.createDataFrame([("S2", v) for v in bad], "participant_id string, value string")).collect()


def test_schedules_of_any_length(spark):
    n = 12_000
    lines = [f"# ORDER;{';'.join(['Base'] * n)}", f"# START;{';'.join(['1.00'] * n)}", f"# END;{';'.join(['2.00'] * n)}"]
    assert release.parse_schedule(spark.createDataFrame([("S2", v) for v in lines], "participant_id string, value string")).count() == n


def test_headers_columns_archives_notes(spark, tmp_path):
    (tmp_path / "S2").mkdir()
    text = tmp_path / "S2" / "r.txt"
    text.write_text('# OpenSignals\n# {"rate": 700, "n": 2}\n# EndOfHeader\n0\t1\t5\n1\t0\t7\n')
    r = release.parse_header(release.text_lines(spark, str(text))).first()
    assert (r["participant_id"], json.loads(r["header"])["rate"], r["n_rows"], r["header_ended"]) == ("S2", 700, 2, True)
    assert [tuple(x) for x in release.numeric_columns(spark, str(text), ["a", "b", "c"]).collect()] == [(0.0, 1.0, 5.0), (1.0, 0.0, 7.0)]
    (tmp_path / "spaced.txt").write_text("# c\n 1   2\t3\n\n4 5  6 \n")
    assert [tuple(x) for x in release.numeric_columns(spark, str(tmp_path / "spaced.txt"), ["a", "b", "c"]).collect()] == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("ACC.csv", "1500000000.0,1500000000.0\n32.0,32.0\n" + "1,2,3\n" * 64)
        z.writestr("info.txt", "no")
    a = release.archive_streams(spark.read.format("binaryFile").load(str(tmp_path / "e.zip"))).collect()
    assert len(a) == 1 and (a[0]["member"], a[0]["start_unix"], a[0]["rate_hz"], a[0]["n_rows"], a[0]["duration_s"]) == ("ACC.csv", 1500000000.0, 32.0, 64, 2.0)
    notes = spark.createDataFrame([("x Additional notes: a b ",), ("none",)], "t string").select(release.notes_after(F.col("t"), "Additional notes:")).collect()
    assert [n[0] for n in notes] == ["a b", None]


def test_config():
    base = {"a": {"b": 1, "c": [1, 2]}, "d": None}
    assert config.merge(base, {"a": {"c": [3]}, "e": 1}) == {"a": {"b": 1, "c": [3]}, "d": None, "e": 1}
    assert config.open_entries({"a": None, "b": {"c": None, "d": [1, None]}}) == ["a", "b.c", "b.d[1]"]
    good = {"windowing": {"length_s": 60, "step_s": 60, "origin_s": 0, "drop_incomplete": True}, "labels": {"positive_code": 2, "negative_code": 1}, "acceleration": {"counts_per_g": 64}}
    assert config.parameters(good).window.length_s == 60.0 and config.binary_reference(good["labels"]) == {1: 0, 2: 1}
    for path, value in (("windowing.length_s", 30), ("windowing.drop_incomplete", False), ("labels.positive_code", 3), ("acceleration.counts_per_g", 63)):
        section, key = path.split(".")
        with pytest.raises(config.ConfigError):
            config.parameters(config.merge(good, {section: {key: value}}))
    with pytest.raises(config.ConfigError):
        config.parameters({"windowing": {}})
    with pytest.raises(config.ConfigError):
        config.binary_reference({"negative_code": 1, "positive_code": 2, "ineligible_codes": [2]})


def test_schema_contract(spark):
    names = [c.name for c in C.all_columns()]
    assert len(names) == len(set(names)) == 117 and len(C.feature_columns()) == 67
    document = C.document(C.all_columns(), {})
    assert len(C.model_features(document)) == 59 and C.struct(C.all_columns())["acc_x_mean"].metadata["role"] == "feature"
    empty = spark.createDataFrame([], C.struct(C.all_columns()))
    assert C.select_model_features(empty, document, ("window_id",)).columns == ["window_id", *document["model_feature_columns"]]
    with pytest.raises(C.ContractError):
        C.select_model_features(empty.drop("acc_x_mean"), document)
    with pytest.raises(C.ContractError):
        C.select_model_features(empty.withColumn("more", F.lit(1)), document)
    with pytest.raises(C.ContractError):
        C.model_features(document | {"model_feature_columns": document["model_feature_columns"][1:]})
    with pytest.raises(C.ContractError):
        C.order_columns(empty.drop("dataset"), C.all_columns())
    assert C.order_columns(empty.select(*names[::-1]), C.all_columns()).columns == names


def test_table_digest_tells_rows_apart_and_not_their_layout(spark):
    rows = [(i % 7, None if i % 5 else float(i), f"v{i % 3}") for i in range(200)]
    make = lambda r: spark.createDataFrame(r, "k int, x double, v string")
    digest, n = integrity.table_digest(make(rows), ["k"])
    assert n == 200 and (digest, n) == integrity.table_digest(make(rows[::-1]).repartition(7), ["k"])
    for other in (rows[1:], [*rows, rows[0]], [*rows[1:], rows[1]], [*rows[1:], (0, 0.5, "v0")], [(k, x, None) for k, x, _ in rows]):
        assert integrity.table_digest(make(other), ["k"])[0] != digest
    assert integrity.table_digest(make(rows).limit(0), ["k"])[1] == 0


def test_tables_with_manifests(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}", None if i % 2 else 1.5) for i in range(50)], "k int, v string, x double")
    manifest = tmp_path / "m.json"
    artifacts.write_table(df, str(tmp_path / "t"), manifest, ["k"])
    assert artifacts.read_table(spark, manifest, ["k"]).count() == 50
    assert integrity.table_digest(df, ["k"]) == integrity.table_digest(df.orderBy(F.desc("k")).repartition(3), ["k"])
    with pytest.raises(artifacts.ArtifactError):
        artifacts.read_table(spark, manifest, ["k"], need_frozen=True)
    for change in ({"rows": 49}, {"row_digest": "0"}, {"schema_version": "0"}, {"columns": ["k"]}):
        manifest.write_text(json.dumps(json.loads(manifest.read_text()) | change))
        with pytest.raises(artifacts.ArtifactError):
            artifacts.read_table(spark, manifest, ["k"])
    with pytest.raises(PySparkException):
        artifacts.write_table(df, str(tmp_path / "t"), manifest, ["k"])
    artifacts.write_csv(spark.sql("select 1 a, array(1, 2) b"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["b"] == "[1,2]"


def test_from_release_to_feature_table(spark, raw, tmp_path):
    base = integrity.write_baseline(spark, str(raw), tmp_path / "b.json")
    assert cli.main(["convert", "--release", str(raw), "--baseline", str(base), "--out", str(tmp_path / "tables")]) == 0
    read = lambda n: spark.read.parquet(str(tmp_path / "tables" / n))
    table = feature_table.build(read("samples"), read("labels"), read("sources")).cache()
    assert table.columns == [c.name for c in C.all_columns()] and table.count() == 6
    rows = {r["window_id"]: r for r in table.collect()}
    one, two, three = (rows[f"wearable:S2:w0000{i}"] for i in range(3))
    assert (one["analysis_label"], two["analysis_label"], three["analysis_label"], three["homogeneous_raw_label"]) == (0, 1, None, 0)
    assert one["q_structural_ok"] and one["q_acc_n_samples"] == 1920 and one["n_label_samples"] == 42000 and one["source_file"] == "S2/S2.pkl"
    data = recording()["signal"]["wrist"]
    g = data["ACC"][:1920] / 64
    mag = np.sqrt((g**2).sum(1))
    assert abs(one["acc_x_std"] - g[:, 0].std()) < 1e-9 and abs(one["acc_mag_p90"] - np.percentile(mag, 90)) < 1e-9 and abs(one["acc_mag_diff_mean_abs"] - np.abs(np.diff(mag)).mean()) < 1e-9
    assert abs(three["temp_slope"] - 0.01) < 1e-9 and abs(two["bvp_iqr"] - np.subtract(*np.percentile(data["BVP"][3840:7680], [75, 25]))) < 1e-9
    assert two["eda_scr_count"] >= 1 and one["q_bvp_hr_available"] and abs(one["hr_median"] - 66) < 3 and one["eda_tonic_mean"] is not None
    assert cli.main(["audit", "--tables", str(tmp_path / "tables"), "--out", str(tmp_path / "audit")]) == 0
    again = feature_table.build(read("samples"), read("labels").withColumn("code", F.lit(3).cast("short")), read("sources"))
    same = ["window_id", "start_seconds", *[c.name for c in C.feature_columns()]]
    assert table.select(*same).exceptAll(again.select(*same)).isEmpty() or table.select("window_id").exceptAll(again.select("window_id")).isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-0{1 + i % 5} 0{i % 9}:00:00", "ab"[i % 2], float(i)) for i in range(40)], "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    streaming.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    late = spark.createDataFrame([(99, "2024-02-01 00:00:00", "a", 0.0)], "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    late.write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark past every window
    streaming.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in streaming.windowed_counts(events).collect()}
