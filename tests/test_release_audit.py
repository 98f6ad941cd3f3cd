"""The audit of a release's own files, over a generated release with planted faults."""

from __future__ import annotations

import json
import pickle
import zipfile

import numpy as np
import pytest
from labelscope import cli
from labelscope.sources import integrity, recording_audit

SECONDS, BEFORE, AFTER = 120, 3, 2


def write_release(root, who, **fault):
    rng = np.random.default_rng(int(who[1:]))
    folder = root / who
    folder.mkdir()
    label = np.zeros(SECONDS * 700, np.int32)
    for code, a, b in ((1, 20, 60), (2, 70, 100), (3, 104, 110), (4, 112, 118)):
        label[a * 700 : b * 700] = code
    raw = rng.integers(0, 65536, (SECONDS + BEFORE + AFTER) * 700)
    chest = {n: rng.normal(size=(SECONDS * 700, 3 if n == "ACC" else 1)) for n in recording_audit.RATES["chest"]}
    chest["ECG"] = ((raw / 65536 - 0.5) * 3)[BEFORE * 700 : (BEFORE + SECONDS) * 700, None]
    acc = rng.integers(-64, 64, ((SECONDS + 9) * 32, 3))
    wrist = {n: rng.normal(size=(int(SECONDS * r), 1)) for n, r in recording_audit.RATES["wrist"].items()}
    wrist["ACC"] = acc[5 * 32 : (5 + SECONDS) * 32].astype(float)
    data = {"subject": who, "label": label, "signal": {"chest": chest, "wrist": wrist}}
    fault.get("change", lambda d: None)(data)
    if "pickle" not in fault.get("without", ()):
        (folder / f"{who}.pkl").write_bytes(fault.get("content") or pickle.dumps(data))
    header = {"dev": {"date": "2017-05-22", "time": fault.get("time", "9:17:23.0"), "sampling rate": 700}}
    lines = ["# OpenSignals", "# " + json.dumps(header), "# EndOfHeader", *(f"{i}\t0\t{v}\t1" for i, v in enumerate(raw))]
    (folder / f"{who}_respiban.txt").write_text("\n".join(lines) + "\n")
    start = 1495437438.0 - 5 + BEFORE + 5  # two hours before the local clock of the header
    with zipfile.ZipFile(folder / f"{who}_E4_Data.zip", "w") as z:
        z.writestr("ACC.csv", f"{start - 5},{start - 5}\n32.0,32.0\n" + "\n".join(",".join(map(str, r)) for r in acc) + "\n")
        z.writestr("TEMP.csv", "1.0\n4.0\n" + "33.1\n" * (SECONDS + 9) * 4)
    clock = lambda s: f"{s // 60}.{s % 60:02d}"
    planned = fault.get("planned", (("Base", 20, 60), ("TSST", 70, 100), ("bRead", 1, 2), ("Fun", 104, 110), ("Medi 1", 112, 118)))
    rows = [["# ORDER", *(p[0] for p in planned)], ["# START", *(clock(p[1] + BEFORE) for p in planned)], ["# END", *(clock(p[2] + BEFORE) for p in planned)]]
    (folder / f"{who}_quest.csv").write_text(fault.get("quest") or "# Subj;x;\n" + "\n".join(";".join([*r, "", ""]) for r in rows) + "\n")
    (folder / f"{who}_readme.txt").write_text("Age: 1\n### Additional notes ###\nleft-handed\n")


def set_signal(device, name, change):
    return lambda d: d["signal"][device].__setitem__(name, change(d["signal"][device][name]))


@pytest.fixture(scope="module")
def audited(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("release")
    nan = lambda x: np.where(np.arange(len(x))[:, None] == 3, np.nan, x)
    plans = {
        "S2": {}, "S3": {"change": set_signal("chest", "EDA", lambda x: x[:-700])}, "S4": {"change": set_signal("wrist", "EDA", nan)}, "S5": {"change": lambda d: d.update(subject="S9")},
        "S6": {"content": b"not a pickle"}, "S7": {"without": ("pickle",)}, "S8": {"change": set_signal("chest", "ECG", lambda x: x + 1)}, "S9": {"change": set_signal("wrist", "ACC", lambda x: x[:, :2])},
        "S10": {"quest": "# ORDER;Base\n# START;1.0;2.0\n# END;1.0\n"}, "S11": {"time": "9:27:23.0"}, "S13": {"planned": (("Base", 20, 60), ("TSST", 75, 100), ("Medi 2", 1, 5))},
        "S14": {"change": lambda d: d.update(label=d["label"] + 0.5)}, "S15": {"change": lambda d: d["signal"].pop("chest")}, "S16": {"change": lambda d: (d["signal"]["wrist"].pop("BVP"), d["signal"]["wrist"].update(HR=np.zeros(0)))},
        "S17": {"change": lambda d: d["label"].__setitem__(slice(0, 10), 9)}, "S18": {"change": lambda d: d.pop("label")},
    }
    for who, fault in plans.items():
        write_release(root, who, **fault)
    out = tmp_path_factory.mktemp("out")
    base = integrity.write_baseline(spark, str(root), out / "b.json")
    assert cli.main(["audit-release", "--release", str(root), "--baseline", str(base), "--out", str(out / "a")]) == 1
    (root / "S2" / "S2_readme.txt").write_text("altered")
    assert cli.main(["audit-release", "--release", str(root), "--baseline", str(base), "--out", str(out / "b")]) == 2
    return out / "a"


def test_faults_become_flags(spark, audited):
    rows = {r["participant_id"]: r for r in spark.read.parquet(str(audited / "audit")).collect()}
    want = {
        "S2": [], "S3": ["chest.EDA_length_ne_label"], "S4": ["wrist.EDA_nonfinite"], "S5": ["pkl_subject_field_mismatch"], "S6": ["pkl_unreadable"], "S7": ["pkl_missing"],
        "S8": ["pkl_chest_not_found_in_raw_respiban", "schedule_alignment_unverified"], "S9": ["wrist.ACC_channels_2_ne_3", "pkl_wrist_not_found_in_raw_e4"], "S10": ["quest_parse_error"],
        "S11": ["device_clocks_disagree_gt_30s"], "S13": ["schedule_Medi 2_no_matching_run", "schedule_offsets_inconsistent_across_conditions"], "S14": ["label_vector_not_integer_valued"],
        "S15": ["chest_missing", "schedule_alignment_unverified"], "S16": ["wrist.BVP_missing", "wrist.HR_undocumented", "wrist.HR_empty"], "S17": ["undocumented_label_codes"], "S18": ["pkl_unexpected_top_level_structure"],
    }
    assert {who: r["flags"] for who, r in rows.items()} == want
    grades = {who: r["classification"].partition(":")[0] for who, r in rows.items()}
    assert [w for w, g in grades.items() if g == "apparently_usable"] == ["S2"]
    assert {w for w, g in grades.items() if g == "unusable"} == {"S6", "S7", "S9", "S13", "S14", "S15", "S16", "S18"}
    assert rows["S16"]["classification"] == "unusable:wrist.BVP_missing" and rows["S6"]["classification"] == "unusable:pkl_unreadable_or_missing"
    one = rows["S2"]
    assert (one["chest_crop_s"], one["wrist_crop_s"], one["rows_minus_labels"], one["notes"], abs(one["residual_s"]) <= 30) == (3.0, 5.0, 5 * 700, "left-handed", True)
    assert [r["code"] for r in one["runs"]] == [0, 1, 0, 2, 0, 3, 0, 4, 0] and one["wrist_raw_minus_recorded_s"]["TEMP"] == 9.0
    assert [(m["condition"], m["matched"], m["start_offset_s"], m["end_offset_s"]) for m in one["schedule_matches"]] == [("Base", True, 0, 0), ("TSST", True, 0, 0), ("Fun", True, 0, 0), ("Medi 1", True, 0, 0)]


def test_flat_tables(spark, audited):
    read = lambda name: spark.read.csv(str(audited / name), header=True, inferSchema=True)
    people = {r["participant_id"]: r for r in read("participants").collect()}
    assert len(people) == 16 and people["S2"]["baseline_duration_s"] == 40.0 and people["S2"]["stress_duration_s"] == 30.0 and people["S2"]["codes_present"] == "0,1,2,3,4" and people["S2"]["recording_duration_s"] == 120.0
    assert people["S16"]["missing_signals"] == "wrist.BVP_missing" and people["S4"]["nan_inf_flags"] == "wrist.EDA_nonfinite" and not people["S15"]["chest_available"]
    signals = {(r["participant_id"], r["device"], r["signal"]): r for r in read("signals").collect()}
    assert signals["S2", "chest", "ACC"]["n_channels"] == 3 and signals["S2", "wrist", "BVP"]["n_samples"] == 120 * 64 and not signals["S16", "wrist", "BVP"]["present"] and signals["S4", "wrist", "EDA"]["n_nan"] == 1
    assert read("runs").filter("participant_id = 'S2'").count() == 9 and read("labels").filter("participant_id = 'S17' AND code = 9").count() == 1


def test_chest_signals_are_read(spark, tmp_path):
    from labelscope.sources import release

    (tmp_path / "r").mkdir()
    write_release(tmp_path / "r", "S2")
    base = integrity.write_baseline(spark, str(tmp_path / "r"), tmp_path / "b.json")
    opened = release.VerifiedRelease.open(spark, tmp_path / "r", base)
    arrays = release.load_recording(opened, "S2")
    assert {f"chest.{n}" for n in release.CHEST} < set(arrays) and arrays["chest.ACC"].shape == (SECONDS * 700, 3) and not arrays["chest.ECG"].flags.writeable
    table = release.chest_table(spark, "S2", arrays)
    assert table.columns == ["participant_id", "sample_index", "acc_x", "acc_y", "acc_z", "ecg", "emg", "eda", "temp", "resp"] and table.count() == SECONDS * 700
    data = {"subject": "S2", "label": arrays["label"], "signal": {"wrist": {n: arrays[n] for n in release.WRIST}, "chest": {n: arrays[f"chest.{n}"][:-1] for n in release.CHEST}}}
    with pytest.raises(release.ReleaseError):
        release.validate_recording(data, "S2")


def test_any_fault_of_a_side_file_is_a_finding(tmp_path):
    import io
    import zipfile

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("ACC.csv", "1,1,1\n32,32,32\n" + "1,2,3\n" * 4000)
    broken = bytearray(made.getvalue())
    broken[50:70] = b"\xff" * 20  # the deflate stream
    locked = bytearray(made.getvalue())
    locked[6] |= 1  # says that the member is encrypted
    locked[locked.index(b"PK\x01\x02") + 8] |= 1
    for who, content in {"S2": bytes(broken), "S3": bytes(locked), "S4": b"no archive"}.items():
        (tmp_path / who).mkdir()
        (tmp_path / who / f"{who}_E4_Data.zip").write_bytes(content)
        (tmp_path / who / f"{who}_quest.csv").write_bytes(b"# ORDER;\xff\xfe\n# START;;;;\n" if who == "S2" else b"")
        assert {"e4_zip_error", "pkl_missing"} <= set(recording_audit.examine(tmp_path / who, who, None).flags)
    for header in ([1, 2], None, 3, {}, {"a": []}, {"a": {"date": 1, "time": "x"}}):
        assert recording_audit._chest_start(header) is None


def test_locate():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 3, (500, 2)).astype(float)
    assert recording_audit.locate(raw, raw[77:300]) == 77 and recording_audit.locate(raw, raw) == 0
    assert recording_audit.locate(raw, raw[77:300] + 1e-10, 1e-9) == 77 and recording_audit.locate(raw, raw[77:300] + 1e-3) is None
    periodic = np.tile([[1.0], [2.0]], (50, 1))
    assert recording_audit.locate(periodic, periodic[:10]) is None and recording_audit.locate(raw[:5], raw) is None and recording_audit.locate(raw, raw[:0]) is None
    late = raw[10:400].copy()
    late[-1] += 5  # agrees in its first rows only
    assert recording_audit.locate(raw, late, probe=20) is None
