"""Commands: convert, audit-release, audit, build, baseline, study. Exit code 0 well, 1 findings, 2 cannot be done."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import asdict
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from labelscope import schema as C
from labelscope.operators import audit, metrics, models, runs, splits, task_models
from labelscope.plans import feature_table, study
from labelscope.session import session
from labelscope.sources import artifacts, config, integrity, recording_audit, release

log = logging.getLogger("labelscope")


def audit_release(spark: SparkSession, tables: str) -> DataFrame:
    """(participant_id, flags, grade) of converted recordings: samples and labels below ``tables``."""
    samples, labels = spark.read.parquet(f"{tables}/samples"), spark.read.parquet(f"{tables}/labels")
    value = samples.withColumn("value", F.coalesce("value", "x"))
    stats = audit.signal_stats(value, ["participant_id", "modality"])
    per = stats.groupBy("participant_id").agg(F.countDistinct("modality").alias("n_signals"), F.sum(F.col("n_nan") + F.col("n_inf")).alias("n_bad"))
    marks = audit.label_audit(labels, ["participant_id"])
    spread = feature_table.durations(samples, labels)
    joined = marks.join(per, "participant_id", "left").join(spread, "participant_id", "left")
    rules = {
        "signal_missing": F.coalesce("n_signals", F.lit(0)) < 4, "label_not_integer_valued": F.col("n_not_integer") > 0, "non_finite_samples": F.col("n_bad") > 0,
        "unexpected_label_code": F.exists("codes", lambda c: (c < 0) | (c > 7)), "missing_condition_codes": ~F.forall(F.array(F.lit(1), F.lit(2)), lambda c: F.array_contains(F.transform("codes", lambda x: x.cast("int")), c)),
        "duration_spread": F.col("spread_s") > 1.0,
    }
    flags = audit.flags(joined, rules, ["participant_id"])
    return flags.withColumn("grade", audit.grade(F.col("flags")))


def _audit(spark: SparkSession, a: argparse.Namespace) -> int:
    graded = audit_release(spark, a.tables).cache()
    artifacts.write_csv(graded, f"{a.out}/participants")
    labels = spark.read.parquet(f"{a.tables}/labels")
    found = runs.contiguous_runs(labels, ["participant_id"], ["sample_index"])
    artifacts.write_csv(runs.run_seconds(found, feature_table.LABEL_RATE), f"{a.out}/runs")
    artifacts.write_csv(runs.code_summary(found, ["participant_id"], feature_table.LABEL_RATE), f"{a.out}/labels")
    return 1 if not graded.filter("grade = 'unusable'").isEmpty() else 0


def _audit_release(spark: SparkSession, a: argparse.Namespace) -> int:
    """The files of a release as they are, before any conversion: one recording is one task."""
    opened = release.VerifiedRelease.open(spark, Path(a.release), Path(a.baseline))
    people = [r[0] for r in release.participants(integrity.hash_tree(spark, a.release)).collect()]
    expected = {p: opened.expected.get(f"{p}/{p}.pkl") for p in people}
    root = str(opened.root.resolve())

    def examine(frames):
        for frame in frames:
            rows = [asdict(recording_audit.examine(Path(root) / p, p, expected[p])) for p in frame["participant_id"]]
            yield pa.RecordBatch.from_pylist([r | {"wrist_raw_minus_recorded_s": list(r["wrist_raw_minus_recorded_s"].items())} for r in rows], schema=to_arrow_schema(kinds))

    kinds = StructType.fromDDL(recording_audit.FOUND)
    tasks = spark.createDataFrame([(p,) for p in people], "participant_id string").repartition(max(1, len(people)))
    found = tasks.mapInArrow(lambda batches: examine(b.to_pandas() for b in batches), kinds)
    found.write.mode("errorifexists").parquet(f"{a.out}/found")
    audited = audit.release_audit(spark.read.parquet(f"{a.out}/found"))
    audited.write.mode("errorifexists").parquet(f"{a.out}/audit")
    audited = spark.read.parquet(f"{a.out}/audit")
    for name, df in audit.release_tables(audited).items():
        artifacts.write_csv(df, f"{a.out}/{name}")
    return 1 if not audited.filter("classification LIKE 'unusable%'").isEmpty() else 0


def _convert(spark: SparkSession, a: argparse.Namespace) -> int:
    opened = release.VerifiedRelease.open(spark, Path(a.release), Path(a.baseline))
    paths = integrity.hash_tree(spark, a.release)
    for r in release.participants(paths).collect():
        arrays = release.load_recording(opened, r[0])
        samples, labels = release.recording_tables(spark, r[0], arrays)
        if (chest := release.chest_table(spark, r[0], arrays)) is not None:
            chest.write.mode("append").parquet(f"{a.out}/chest")
        samples.write.mode("append").parquet(f"{a.out}/samples")
        labels.write.mode("append").parquet(f"{a.out}/labels")
    paths.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("participant_id"), F.col("path").alias("source_file"), F.col("sha256").alias("source_sha256")).filter(
        F.col("source_file").endswith(".pkl")
    ).write.parquet(f"{a.out}/sources")
    return 0


def _build(spark: SparkSession, a: argparse.Namespace) -> int:
    p = config.parameters(config.load(a.dataset, Path(a.configs)))
    read = lambda name: spark.read.parquet(f"{a.tables}/{name}")
    table = feature_table.build(read("samples"), read("labels"), read("sources"), a.dataset, p.window, p.eda, p.bvp, p.quality)
    artifacts.write_table(table, f"{a.out}/windows", Path(a.out) / "windows_manifest.json", ["window_id"])
    artifacts.write_schema(Path(a.out) / "feature_schema.json", {"window_s": p.window.length_s})
    artifacts.write_csv(audit.count_summary(spark.read.parquet(f"{a.out}/windows")), f"{a.out}/summary")
    return 0


def _baseline(spark: SparkSession, a: argparse.Namespace) -> int:
    models.assert_grids_frozen()
    table = artifacts.read_table(spark, Path(a.table) / "windows_manifest.json", ["window_id"])
    document = json.loads((Path(a.table) / "feature_schema.json").read_text())
    columns = C.model_features(document)
    rows = C.select_model_features(table, document, ("participant_id", "window_id", "analysis_label", "binary_eligible"))
    rows = rows.withColumn("y", F.when(F.col("binary_eligible"), F.col("analysis_label").cast("int")))
    participants = [r[0] for r in rows.select("participant_id").distinct().collect()]
    folds = splits.lopo_folds(rows.select("participant_id"))
    if not splits.cover_violations(folds, rows.select("participant_id")).isEmpty():
        return 2
    families = ["majority", *models.GRIDS]
    made = task_models.out_of_fold_predictions(rows, columns, families, trees=a.trees, rounds=a.rounds)
    made.write.mode("errorifexists").parquet(f"{a.out}/_predictions")
    made = spark.read.parquet(f"{a.out}/_predictions")
    if not models.prediction_faults(made, rows, families).isEmpty():
        return 2
    artifacts.write_table(made, f"{a.out}/predictions", Path(a.out) / "predictions_manifest.json", ["model_family", "window_id"], frozen=True, participants=len(participants))
    scored = metrics.require_both_classes(metrics.classification_metrics(made.filter("y IS NOT NULL").withColumn("p", F.col("prob_positive")), ["participant_id", "model_family"]))
    artifacts.write_csv(scored, f"{a.out}/per_participant_metrics")
    artifacts.write_csv(metrics.family_summary(scored, families), f"{a.out}/model_summary")
    return 0


def _study(spark: SparkSession, a: argparse.Namespace) -> int:
    made = artifacts.read_table(spark, Path(a.predictions) / "predictions_manifest.json", ["model_family", "window_id"], need_frozen=True)
    labels = made.select("participant_id", "window_id", "y").distinct()
    n = labels.select("participant_id").distinct().count()
    tables = study.run(made, labels, -(-2 * n // 3), a.repetitions)
    if not tables["control"].isEmpty():
        return 2
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{a.out}/{name}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="labelscope", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, options in {
        "convert": ("release", "baseline", "out"), "audit-release": ("release", "baseline", "out"), "audit": ("tables", "out"), "build": ("tables", "configs", "dataset", "out"), "baseline": ("table", "out"), "study": ("predictions", "out"),
    }.items():
        p = sub.add_parser(name)
        for o in options:
            p.add_argument(f"--{o}", required=True)
        if name == "baseline":
            p.add_argument("--trees", type=int, default=models.TREES)
            p.add_argument("--rounds", type=int, default=models.ROUNDS)
        if name == "study":
            p.add_argument("--repetitions", type=int, default=500)
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    try:
        return {"convert": _convert, "audit-release": _audit_release, "audit": _audit, "build": _build, "baseline": _baseline, "study": _study}[a.command](session(), a)
    except (config.ConfigError, artifacts.ArtifactError, release.ReleaseError, C.ContractError, OSError) as problem:
        log.error("%s", problem)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
