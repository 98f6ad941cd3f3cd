"""The jobs as registered queries, each run twice into a folder of its own, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import annotation_study, window_feed
from labelscope.plans import evaluation, tables
from labelscope.plans.registry import DIGITS, rounded
from labelscope.shared import shared_folder


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_annotation_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report after two runs over the whole tables."""
    out = _new_folder(spark, "job1")
    for _ in range(2):
        annotation_study.run(spark, sf_dir, out)
    return rounded(annotation_study.read_back(spark, out, "report"))


def job2_window_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows after two runs, of which the second finds nothing new. The pattern lets the table be a folder or a single file."""
    out = _new_folder(spark, "job2")
    for _ in range(2):
        window_feed.run(spark, f"{sf_dir}/events.parque[t]", f"{out}/tables", f"{out}/checkpoint")
    return rounded(spark.read.parquet(f"{out}/tables/windows"))


def _round(columns: str, sql: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {DIGITS}) + 0.0 AS {c}' for c in columns.split())}) FROM ({sql})"


_MEASURES = annotation_study.MEASURES
JOB1_SQL = _round(
    " ".join(f"{p}{m}" for p in ("", "full_", "off_") for m in _MEASURES),
    f"""{evaluation.OBSERVED}, counted AS (SELECT m.participant_id, fraction, count(*) AS selected_count, count(y) AS eligible_selected_count, count(*) FILTER (y = 0) AS baseline_selected_count,
        count(*) FILTER (y = 1) AS stress_selected_count FROM mask m JOIN windows w ON w.participant_id = m.participant_id AND w.window_id = m.window_id GROUP BY ALL)
    SELECT c.participant_id, f.model_family, c.fraction, selected_count, eligible_selected_count, baseline_selected_count, stress_selected_count, baseline_selected_count > 0 AND stress_selected_count > 0 AS ba_estimable,
        {", ".join(f"o.{m}" for m in _MEASURES)}, {", ".join(f"u.{m} AS full_{m}" for m in _MEASURES)}, {", ".join(f"o.{m} - u.{m} AS off_{m}" for m in _MEASURES)}
    FROM counted c JOIN (SELECT DISTINCT participant_id, model_family FROM predictions) f USING (participant_id)
    LEFT JOIN observed o ON o.participant_id = c.participant_id AND o.fraction = c.fraction AND o.model_family = f.model_family
    LEFT JOIN full_ u ON u.participant_id = c.participant_id AND u.model_family = f.model_family""",
)

_LENGTH, _PERIOD = int(window_feed.DEFAULTS["window_seconds"]), window_feed.DEFAULTS["windows_per_period"]
JOB2_SQL = _round(
    "mean_value std_value min_value max_value",
    f"""WITH {tables.SAMPLES}, w AS (SELECT *, CAST(floor(sample_index / {_LENGTH}) AS INTEGER) AS window_index FROM samples WHERE participant_id IS NOT NULL AND sample_index >= 0),
    g AS (SELECT participant_id, window_index, count(*) AS n_samples, list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)) AS codes, CASE WHEN min(code) = max(code) AND count(code) = count(*) THEN min(code) END AS code,
        avg(value) AS mean_value, sqrt(greatest(0.0, avg(value * value) - avg(value) * avg(value))) AS std_value, min(value) AS min_value, max(value) AS max_value,
        min(sample_index) AS first_sample, max(sample_index) AS last_sample FROM w GROUP BY ALL)
    SELECT participant_id, window_index, 'events:' || participant_id || ':w' || lpad(CAST(window_index AS VARCHAR), 5, '0') AS window_id, n_samples, array_to_string(list_transform(codes, lambda c: CAST(c AS VARCHAR)), ',') AS raw_label_codes_present,
        CASE code WHEN 0 THEN 'transient' WHEN 1 THEN 'baseline' WHEN 2 THEN 'stress' WHEN 3 THEN 'amusement' WHEN 4 THEN 'meditation' ELSE 'mixed' END AS condition_name, CASE WHEN code IS NULL THEN 'mixed_label_codes' WHEN code IN (1, 2) THEN '' ELSE 'homogeneous_code_' || code || '_outside_binary_reference' END AS ineligibility_reason,
        mean_value, std_value, min_value, max_value, first_sample, last_sample, CAST(floor(window_index / {_PERIOD}) AS INTEGER) AS period FROM g""",
)

QUERIES = {"job1_annotation_study": job1_annotation_study, "job2_window_feed": job2_window_feed}
ORACLE = {"job1_annotation_study": JOB1_SQL, "job2_window_feed": JOB2_SQL}
