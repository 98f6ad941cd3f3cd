"""The two jobs: against SQL, run again, over growing input, and after a failure half way."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest
from jobs import annotation_study, queries, window_feed
from jobs.common import configured
from pyspark.sql import functions as F
from test_queries import canonical

ROOT = Path(__file__).resolve().parent.parent


def rows_of(df):
    return canonical(df.toPandas())


@pytest.fixture
def pieces(spark, small, tmp_path):
    """Events of the small tables in three files, and a function that adds one of them to a growing folder."""
    events, grown = spark.read.parquet(f"{small}/events.parquet"), tmp_path / "events"

    def add(k: int) -> str:
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(grown))
        return str(grown)

    return add


def test_feed_over_growing_input_equals_one_run_over_all(spark, pieces, tmp_path, caplog):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    caplog.set_level("INFO", "labelscope.jobs")
    for k in range(3):
        folder = pieces(k)
        window_feed.run(spark, folder, out, checkpoint)
        assert spark.read.parquet(f"{out}/partials").select("batch").distinct().count() == k + 1
    assert spark.read.parquet(f"{out}/partials").agg(F.sum("n")).first()[0] == spark.read.parquet(folder).count()  # every event once
    grown = rows_of(spark.read.parquet(f"{out}/windows"))
    window_feed.run(spark, folder, out, checkpoint)
    assert "no new events" in caplog.text and rows_of(spark.read.parquet(f"{out}/windows")) == grown
    window_feed.run(spark, folder, str(tmp_path / "whole"), str(tmp_path / "other"))
    assert rows_of(spark.read.parquet(f"{tmp_path}/whole/windows")) == grown


def test_feed_rewrites_only_touched_periods(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    day = lambda k, value: (k, __import__("datetime").datetime(2024, 1, k), 7, "view", value, None)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("events", "out", "checkpoint"))
    spark.createDataFrame([day(1, 1.0), day(25, 5.0)], schema).coalesce(1).write.parquet(folder)
    window_feed.run(spark, folder, out, checkpoint)
    before = {p.parent.name: p.name for p in Path(out, "windows").glob("period=*/*.parquet")}
    spark.createDataFrame([day(2, None), (9, None, 7, "view", 1.0, None), (8, __import__("datetime").datetime(2023, 1, 1), 7, "view", 1.0, None)], schema).coalesce(1).write.mode("append").parquet(folder)
    window_feed.run(spark, folder, out, checkpoint)
    after = {p.parent.name: p.name for p in Path(out, "windows").glob("period=*/*.parquet")}
    assert set(before) == set(after) and [k for k in before if before[k] != after[k]] == ["period=0"]
    first = spark.read.parquet(f"{out}/windows").filter("period = 0").first()
    assert (first["n_samples"], first["mean_value"], first["std_value"]) == (2, 1.0, 0.0)


def test_feed_goes_on_after_a_failure_before_the_windows(spark, pieces, tmp_path, monkeypatch):
    folder, out, checkpoint = pieces(0), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    settings = configured(spark, window_feed.CONFIG, window_feed.DEFAULTS)
    window_feed.take_new(spark, folder, out, checkpoint, settings)  # and died
    pieces(1)
    window_feed.run(spark, folder, out, checkpoint)
    window_feed.run(spark, folder, str(tmp_path / "whole"), str(tmp_path / "other"))
    assert rows_of(spark.read.parquet(f"{out}/windows")) == rows_of(spark.read.parquet(f"{tmp_path}/whole/windows"))


def test_study_reruns_with_the_same_result(spark, small, tmp_path):
    out, config = str(tmp_path / "out"), tmp_path / "config.json"
    annotation_study.run(spark, small, out)
    first = {n: rows_of(annotation_study.read_back(spark, out, n)) for n in ("worklist", "report")}
    config.write_text(json.dumps({"fractions": ["0.50"]}))
    annotation_study.run(spark, small, out, str(config))  # one partition again, the others stay
    assert first == {n: rows_of(annotation_study.read_back(spark, out, n)) for n in first}
    assert {p.name for p in Path(out, "report").glob("fraction=*")} == {f"fraction={f}" for f in ("0.25", "0.50", "0.75", "1.00")}
    whole = annotation_study.read_back(spark, out, "report").filter("fraction = '1.00' AND balanced_accuracy IS NOT NULL")
    assert whole.filter("abs(off_balanced_accuracy) > 1e-12").count() == 0 and whole.count() > 0


def test_unknown_settings_are_refused(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"fraction": 1}')
    with pytest.raises(ValueError, match="unknown settings"):
        configured(spark, str(tmp_path / "c.json"), annotation_study.DEFAULTS)


def test_settings_of_the_session_stay(spark, small):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.session.timeZone", "spark.sql.shuffle.partitions")}
    for query in queries.QUERIES.values():
        assert query(spark, small).count() > 0
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_command_lines(small, tmp_path):
    run = lambda *args: subprocess.run([sys.executable, "-m", *args], cwd=ROOT, capture_output=True, text=True, check=False)
    made = run("jobs.window_feed", "--events", f"{small}/events.parque[t]", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/checkpoint")
    assert made.returncode == 0 and "wrote" in made.stderr and list(Path(tmp_path, "out", "windows").glob("period=*/*.parquet"))
    made = run("jobs.annotation_study", "--tables", small, "--out", f"{tmp_path}/study")
    assert made.returncode == 0 and "wrote" in made.stderr and list(Path(tmp_path, "study", "report").glob("fraction=*/*.parquet"))


def test_jobs_do_not_import_the_pipeline_operators():
    for path in (ROOT / "jobs").glob("*.py"):
        text = path.read_text()
        assert "llm" not in text and "corpus_pipeline" not in text
