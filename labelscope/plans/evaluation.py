"""Queries over predictions and partly known labels: metrics, splits, models, observation policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.functions import scalars as S
from labelscope.operators import abstain, metrics, models, observe, splits, task_models
from labelscope.operators.ranked import running_totals
from labelscope.plans.registry import query
from labelscope.plans.tables import PREDICTIONS, WINDOWS, predictions, read, scores, windows

FAMILIES = list(observe.FAMILIES)
KEY = ["participant_id", "model_family"]
BASE = f"WITH {PREDICTIONS}"
EPS = S.EPSILON
#: Participants that a selection needs: two thirds of 20.
LEAST = 14

CONFUSION = """sum(CASE WHEN y = 0 AND hard = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN y = 0 AND hard = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND hard = 0 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN y = 1 AND hard = 1 THEN 1 ELSE 0 END) AS tp, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1"""
FROM_CONFUSION = """CASE WHEN n0 > 0 THEN tn / n0 END AS baseline_recall, CASE WHEN n1 > 0 THEN tp / n1 END AS stress_recall,
  CASE WHEN n0 > 0 AND n1 > 0 THEN (tn / n0 + tp / n1) / 2 END AS balanced_accuracy,
  CASE WHEN n0 > 0 AND n1 > 0 THEN (CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2 END AS macro_f1"""
PROBABILITY = f"""avg((p - y) * (p - y)) AS brier, avg(-CASE WHEN y = 1 THEN ln(least(greatest(p, {EPS!r}), 1.0::DOUBLE - {EPS!r})) ELSE ln(1.0::DOUBLE - least(greatest(p, {EPS!r}), 1.0::DOUBLE - {EPS!r})) END) AS log_loss"""
FULL = f"""{BASE}, rows_ AS (SELECT *, prob_positive AS p FROM predictions WHERE y IS NOT NULL),
c AS (SELECT participant_id, model_family, {CONFUSION}, {PROBABILITY} FROM rows_ GROUP BY participant_id, model_family),
full_ AS (SELECT *, {FROM_CONFUSION} FROM c)"""
METRICS = "baseline_recall stress_recall balanced_accuracy macro_f1"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).withColumn("p", F.col("prob_positive"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select("participant_id", "window_id", "y")


@query("confusion_metrics", f"{FULL} SELECT participant_id, model_family, * EXCLUDE (participant_id, model_family, brier, log_loss, tn, fp, fn, tp), CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM full_", METRICS)
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classification_metrics(rows(spark, sf_dir).filter("y IS NOT NULL"), KEY)


@query("probabilistic_metrics", f"{FULL} SELECT participant_id, model_family, n0 + n1 AS n_labels, brier, log_loss FROM full_", "brier log_loss")
def probabilistic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.probabilistic_metrics(rows(spark, sf_dir).filter("y IS NOT NULL"), KEY)


@query(
    "ranking_metrics",
    f"""{BASE}, r AS (SELECT *, rank() OVER (PARTITION BY participant_id, model_family ORDER BY prob_positive) + (count(*) OVER (PARTITION BY participant_id, model_family, prob_positive) - 1) / 2.0::DOUBLE AS rk FROM predictions WHERE y IS NOT NULL),
    n AS (SELECT participant_id, model_family, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(rk) FILTER (y = 1) AS s1 FROM r GROUP BY ALL),
    g AS (SELECT participant_id, model_family, prob_positive AS p, count(*) FILTER (y = 1) AS a, count(*) AS b FROM predictions WHERE y IS NOT NULL GROUP BY ALL),
    t AS (SELECT *, sum(a) OVER w AS ctp, sum(b) OVER w AS cn FROM g WINDOW w AS (PARTITION BY participant_id, model_family ORDER BY p DESC)), ap AS (SELECT participant_id, model_family, sum(a * ctp / cn) AS s FROM t GROUP BY ALL)
    SELECT n.participant_id, n.model_family, n0, n1, CASE WHEN n0 > 0 AND n1 > 0 THEN (s1 - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) END AS auroc, CASE WHEN n0 > 0 AND n1 > 0 THEN s / n1 END AS average_precision
    FROM n JOIN ap USING (participant_id, model_family)""",
    "auroc average_precision",
)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_metrics(rows(spark, sf_dir), KEY)


_ACROSS = "avg(balanced_accuracy) AS mean, quantile_cont(balanced_accuracy, 0.5) AS median, stddev_samp(balanced_accuracy) AS std, min(balanced_accuracy) AS min, max(balanced_accuracy) AS max, count(balanced_accuracy) AS n"


@query("model_summary", f"""{FULL}, s AS (SELECT model_family, {_ACROSS} FROM full_ GROUP BY model_family) SELECT *, CAST(row_number() OVER (ORDER BY mean DESC NULLS LAST, list_position(['logistic', 'random_forest', 'xgboost', 'majority'], model_family)) AS INTEGER) AS position FROM s""", "mean median std min max")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.family_summary(observe.full_metrics(rows(spark, sf_dir)), [*FAMILIES, "majority"])


@query("risk_coverage", f"""{BASE}, s AS (SELECT participant_id, model_family, greatest(prob_positive, 1 - prob_positive) AS confidence, count(*) AS n, sum(CASE WHEN hard <> y THEN 1 ELSE 0 END) AS e FROM predictions WHERE y IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER o AS nk, sum(e) OVER o AS ek, sum(n) OVER (PARTITION BY participant_id, model_family) AS nt FROM s WINDOW o AS (PARTITION BY participant_id, model_family ORDER BY confidence DESC))
    SELECT participant_id, model_family, confidence, CAST(nk AS BIGINT) AS n_kept, nk / nt AS coverage, ek / nk AS error_rate FROM w""", "confidence coverage error_rate")
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.risk_coverage(rows(spark, sf_dir), KEY)


@query(
    "abstention_outcomes",
    f"""{BASE}, d AS (SELECT *, greatest(prob_positive, 1 - prob_positive) >= 0.75 AS keep FROM predictions) SELECT participant_id, model_family, count(*) FILTER (keep) / count(*) AS coverage,
    count(*) FILTER (keep AND y IS NOT NULL) AS n_judged, CASE WHEN count(*) FILTER (keep AND y IS NOT NULL) > 0 THEN count(*) FILTER (keep AND hard <> y) / count(*) FILTER (keep AND y IS NOT NULL) END AS error_rate FROM d GROUP BY ALL""",
    "coverage error_rate",
)
def abstention_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abstain.outcomes(predictions(spark, sf_dir), abstain.predicted("raw_confidence", 0.75), KEY)


@query("child_seeds", "SELECT doc_id, CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) AS seed FROM (SELECT doc_id, sha256('42:model_fit:logistic:S' || doc_id) AS h FROM documents)")
def child_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = F.concat(F.lit("model_fit:logistic:S"), F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", S.child_seed(42, stream).alias("seed"))


_RANKED = f"""{BASE}, learned AS (SELECT * FROM predictions WHERE model_family <> 'majority'),
rk AS (SELECT *, rank() OVER (PARTITION BY participant_id, model_family ORDER BY prob_positive) + (count(*) OVER (PARTITION BY participant_id, model_family, prob_positive) - 1) / 2.0::DOUBLE AS average_rank,
  count(*) OVER (PARTITION BY participant_id, model_family) AS n FROM learned),
pr AS (SELECT *, CASE WHEN n = 1 THEN 0.0::DOUBLE ELSE (average_rank - 1) / (n - 1) END AS percentile_rank FROM rk),
cs AS (SELECT participant_id, window_id, avg(percentile_rank) AS consensus_score FROM pr GROUP BY participant_id, window_id),
ts AS (SELECT CAST(CAST('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2] AS BIGINT) AS VARCHAR) AS seed FROM (SELECT sha256('42:study_a_selector_tie') AS h)),
pl AS (SELECT cs.*, row_number() OVER (PARTITION BY participant_id ORDER BY round(consensus_score, 12) DESC, sha256((SELECT seed FROM ts) || ':' || participant_id || ':' || window_id)) AS place, count(*) OVER (PARTITION BY participant_id) AS n FROM cs),
fr AS (SELECT unnest(['0.25', '0.50', '0.75', '1.00']) AS fraction),
mask AS (SELECT participant_id, fraction, window_id FROM pl, fr WHERE place <= floor(CAST(fraction AS DOUBLE) * n))"""


@query("percentile_ranks", f"{_RANKED} SELECT participant_id, window_id, model_family, average_rank, percentile_rank FROM pr", "average_rank percentile_rank")
def percentile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = scores(spark, sf_dir).filter("model_family <> 'majority'")
    return metrics.average_rank(learned, KEY, "prob_positive").select("participant_id", "window_id", "model_family", "average_rank", "percentile_rank")


@query("consensus_scores", f"{_RANKED} SELECT * FROM cs", "consensus_score")
def consensus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.consensus(scores(spark, sf_dir))


@query("budgets", f"{_RANKED} SELECT DISTINCT participant_id, fraction, n AS n_windows, CAST(floor(CAST(fraction AS DOUBLE) * n) AS INTEGER) AS budget FROM pl, fr")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.budgets(scores(spark, sf_dir))


@query("targeted_mask", f"{_RANKED} SELECT * FROM mask")
def targeted_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.targeted_mask(scores(spark, sf_dir))


@query(
    "label_yield",
    f"""{_RANKED}, f AS (SELECT participant_id, count(*) FILTER (y = 0) AS f0, count(*) FILTER (y = 1) AS f1 FROM windows GROUP BY participant_id),
    g AS (SELECT m.participant_id, fraction, count(*) AS selected_count, count(y) AS eligible_selected_count, count(*) FILTER (y = 0) AS baseline_selected_count, count(*) FILTER (y = 1) AS stress_selected_count
      FROM mask m JOIN windows w ON w.participant_id = m.participant_id AND w.window_id = m.window_id GROUP BY ALL)
    SELECT g.*, selected_count - eligible_selected_count AS ineligible_selected_count, eligible_selected_count / selected_count AS label_yield_fraction,
      CASE WHEN f0 > 0 THEN baseline_selected_count / f0 END AS baseline_coverage, CASE WHEN f1 > 0 THEN stress_selected_count / f1 END AS stress_coverage,
      baseline_selected_count > 0 AND stress_selected_count > 0 AS ba_estimable FROM g JOIN f USING (participant_id)""",
    "label_yield_fraction baseline_coverage stress_coverage",
)
def label_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.label_yield(observe.targeted_mask(scores(spark, sf_dir)), labels(spark, sf_dir), ["fraction"])


OBSERVED = f"""{_RANKED}, ob AS (SELECT m.participant_id, fraction, model_family, prob_positive AS p, hard, y FROM mask m JOIN predictions q ON q.participant_id = m.participant_id AND q.window_id = m.window_id WHERE y IS NOT NULL),
oc AS (SELECT participant_id, fraction, model_family, {CONFUSION}, {PROBABILITY} FROM ob GROUP BY participant_id, fraction, model_family), observed AS (SELECT *, {FROM_CONFUSION} FROM oc),
fc AS (SELECT participant_id, model_family, {CONFUSION}, {PROBABILITY} FROM (SELECT *, prob_positive AS p FROM predictions WHERE y IS NOT NULL) GROUP BY participant_id, model_family), full_ AS (SELECT *, {FROM_CONFUSION} FROM fc)"""


def _targeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.observed_metrics(observe.targeted_mask(scores(spark, sf_dir)), rows(spark, sf_dir), ["fraction"])


@query("observed_metrics", f"{OBSERVED} SELECT participant_id, fraction, model_family, n0, n1, baseline_recall, stress_recall, balanced_accuracy, macro_f1, brier, log_loss FROM observed", f"{METRICS} brier log_loss")
def observed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targeted(spark, sf_dir).select("participant_id", "fraction", "model_family", "n0", "n1", *METRICS.split(), "brier", "log_loss")


_DISTORTION = f"""{OBSERVED}, d AS (SELECT o.participant_id, fraction, avg(abs(o.balanced_accuracy - f.balanced_accuracy)) AS d_ba, avg(abs(o.brier - f.brier)) AS d_brier, avg(abs(o.log_loss - f.log_loss)) AS d_log_loss
  FROM observed o JOIN full_ f ON o.participant_id = f.participant_id AND o.model_family = f.model_family WHERE o.model_family <> 'majority' GROUP BY o.participant_id, fraction)"""


@query("distortion", f"{_DISTORTION} SELECT * FROM d", "d_ba d_brier d_log_loss")
def distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.distortion(_targeted(spark, sf_dir), observe.full_metrics(rows(spark, sf_dir)), ["fraction"])


@query(
    "distortion_summary",
    f"""{_DISTORTION} SELECT fraction, avg(d_ba) AS mean, quantile_cont(d_ba, 0.5) AS median, quantile_cont(d_ba, 0.25) AS q25, quantile_cont(d_ba, 0.75) AS q75, min(d_ba) AS min, max(d_ba) AS max,
    count(*) FILTER (d_ba > 1e-12) AS n_positive, count(*) FILTER (abs(d_ba) <= 1e-12) AS n_zero, count(*) FILTER (d_ba < -1e-12) AS n_negative, count(d_ba) AS n_evaluable, count(*) AS n_participants,
    coalesce(string_agg(participant_id, ',' ORDER BY participant_id) FILTER (d_ba IS NOT NULL), '') AS evaluable_ids FROM d GROUP BY fraction""",
    "mean median q25 q75 min max",
)
def distortion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.contrast_summary(observe.distortion(_targeted(spark, sf_dir), observe.full_metrics(rows(spark, sf_dir)), ["fraction"]), "d_ba")


_REGRET = f"""{OBSERVED}, cohort AS (SELECT model_family, avg(balanced_accuracy) AS F_m, list_position(['logistic', 'random_forest', 'xgboost'], model_family) AS o FROM full_ WHERE model_family <> 'majority' GROUP BY model_family),
fb AS (SELECT model_family AS full_best, (SELECT max(F_m) FROM cohort) AS F_top FROM cohort WHERE F_m >= (SELECT max(F_m) FROM cohort) - 1e-12 ORDER BY o LIMIT 1),
mm AS (SELECT fraction, o.model_family, avg(o.balanced_accuracy) AS obs, avg(f.balanced_accuracy) AS sub, count(DISTINCT o.participant_id) AS n, list_position(['logistic', 'random_forest', 'xgboost'], o.model_family) AS k
  FROM observed o JOIN full_ f ON o.participant_id = f.participant_id AND o.model_family = f.model_family WHERE o.model_family <> 'majority' AND o.balanced_accuracy IS NOT NULL GROUP BY fraction, o.model_family),
mx AS (SELECT fraction, max(obs) AS mo, max(sub) AS ms, max(n) AS n FROM mm GROUP BY fraction),
s1 AS (SELECT mm.fraction, arg_min(model_family, k) AS sel FROM mm JOIN mx ON mm.fraction = mx.fraction WHERE obs >= mo - 1e-12 GROUP BY mm.fraction),
s2 AS (SELECT mm.fraction, arg_min(model_family, k) AS best FROM mm JOIN mx ON mm.fraction = mx.fraction WHERE sub >= ms - 1e-12 GROUP BY mm.fraction),
rg AS (SELECT mx.fraction, mx.n AS n_estimable, mx.n >= {LEAST} AS ok, sel, best, F_top - F_m AS rc, ms - sub AS rs, full_best FROM mx JOIN s1 ON s1.fraction = mx.fraction JOIN s2 ON s2.fraction = mx.fraction
  JOIN mm ON mm.fraction = mx.fraction AND mm.model_family = sel JOIN cohort ON cohort.model_family = sel, fb),
regret AS (SELECT fraction, n_estimable, ok AS estimable, CASE WHEN ok THEN sel END AS selected_model, CASE WHEN ok THEN rc END AS r_cohort, CASE WHEN ok THEN rs END AS r_subset, CASE WHEN ok THEN sel <> full_best END AS top_model_changed,
  CASE WHEN ok THEN best END AS subset_full_best_model, CASE WHEN ok THEN sel <> best END AS subset_top_model_changed FROM rg)"""


@query("selection_regret", f"{_REGRET} SELECT * FROM regret", "r_cohort r_subset")
def selection_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.selection_regret(_targeted(spark, sf_dir), observe.full_metrics(rows(spark, sf_dir)), ["fraction"], LEAST)


_SAME = " OR ".join(f"(o.{n} IS NULL) <> (f.{n} IS NULL) OR coalesce(abs(o.{n} - f.{n}) > 1e-12, false)" for n in ("balanced_accuracy", "macro_f1", "brier", "log_loss"))


@query(
    "full_budget_control",
    f"""{OBSERVED} SELECT f.participant_id, f.model_family, fr.fraction FROM full_ f CROSS JOIN fr
    LEFT JOIN observed o ON o.participant_id = f.participant_id AND o.model_family = f.model_family AND o.fraction = fr.fraction
    WHERE o.n0 IS DISTINCT FROM f.n0 OR o.n1 IS DISTINCT FROM f.n1 OR {_SAME}""",
)
def full_budget_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the masks of each budget give other metrics than the full reference: nowhere for the whole budget."""
    seen, full, out = _targeted(spark, sf_dir), observe.full_metrics(rows(spark, sf_dir)), None
    for fraction in observe.FRACTIONS:
        found = observe.control_violations(seen.filter(F.col("fraction") == fraction), full).withColumn("fraction", F.lit(fraction))
        out = found if out is None else out.unionByName(found)
    return out


@query("label_bounds", f"{BASE} SELECT participant_id, model_family, count(*) FILTER (hard = y) / count(*) AS accuracy_low, (count(*) FILTER (hard = y) + count(*) FILTER (y IS NULL)) / count(*) AS accuracy_high, count(y) AS n_labels FROM predictions GROUP BY ALL", "accuracy_low accuracy_high")
def label_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.label_bounds(rows(spark, sf_dir), KEY)


@query("select_best", f"""{FULL}, c2 AS (SELECT participant_id, list(coalesce(balanced_accuracy, 0.5) ORDER BY model_family) AS s FROM full_ GROUP BY participant_id)
    SELECT participant_id, CAST(CASE WHEN greatest(s[2], s[3], s[4]) <= s[1] + 1e-12 THEN 0 ELSE list_position(s, list_max(s)) - 1 END AS INTEGER) AS best FROM c2""")
def select_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = observe.full_metrics(rows(spark, sf_dir)).groupBy("participant_id")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("model_family", F.coalesce("balanced_accuracy", F.lit(0.5)).alias("s")))), lambda x: x["s"])
    return full.agg(scores.alias("scores")).select("participant_id", metrics.select_best(F.col("scores")).alias("best"))


@query("random_masks")
def random_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.random_masks(scores(spark, sf_dir).filter("model_family = 'logistic'"))


def _random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.random_observed(rows(spark, sf_dir))


@query("observation_contrast")
def observation_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targeted against 500 random realisations: distortion and availability contrasts by participant and budget."""
    full = observe.full_metrics(rows(spark, sf_dir))
    t = observe.distortion(_targeted(spark, sf_dir), full, ["fraction"])
    r = observe.distortion(_random(spark, sf_dir), full, ["fraction", "rep"])
    return observe.contrast(t, r, observe.REPETITIONS, observe.budgets(scores(spark, sf_dir)))


@query("random_selection_summary")
def random_selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    regrets = observe.selection_regret(_random(spark, sf_dir), observe.full_metrics(rows(spark, sf_dir)), ["fraction", "rep"], LEAST)
    return observe.selection_summary(regrets, ["fraction"])


#: Draws by digests of names, as SQL can make them too: DRAWS masks for each participant and budget.
DRAWS = 5
_DRAWN = f"""draws AS (SELECT unnest(range(0, {DRAWS})) AS rep),
dm AS (SELECT participant_id, fraction, rep, window_id FROM (SELECT pl.participant_id, fraction, rep, pl.window_id, n, row_number() OVER (PARTITION BY pl.participant_id, fraction, rep
  ORDER BY sha256(pl.window_id || ':' || fraction || ':' || rep)) AS r FROM pl, fr, draws) WHERE r <= floor(CAST(fraction AS DOUBLE) * n))"""


def _drawn(spark: SparkSession, sf_dir: str, draws: int = DRAWS) -> DataFrame:
    ids = windows(spark, sf_dir).select("participant_id", "window_id")
    budgets_ = F.broadcast(observe.budgets(scores(spark, sf_dir)))  # a row a participant and fraction
    each = ids.join(budgets_, "participant_id").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    key = ["participant_id", "fraction", "rep"]
    digest = F.sha2(F.concat_ws(":", "window_id", "fraction", F.col("rep").cast("string")), 256)
    placed = running_totals(each.select(*key, "window_id", "budget"), key, {"digest": digest}, {"n": F.lit(1)})
    return placed.filter("n_before < budget").select(*key, "window_id")


@query(
    "contrast_of_digest_draws",
    f"""{_DISTORTION}, {_DRAWN}, ro AS (SELECT m.participant_id, fraction, rep, model_family, prob_positive AS p, hard, y FROM dm m JOIN predictions q ON q.participant_id = m.participant_id AND q.window_id = m.window_id WHERE y IS NOT NULL),
    rc AS (SELECT participant_id, fraction, rep, model_family, {CONFUSION}, {PROBABILITY} FROM ro GROUP BY ALL), rs AS (SELECT *, {FROM_CONFUSION} FROM rc),
    rd AS (SELECT r.participant_id, fraction, rep, avg(abs(r.balanced_accuracy - f.balanced_accuracy)) AS d_ba, avg(abs(r.brier - f.brier)) AS d_brier, avg(abs(r.log_loss - f.log_loss)) AS d_log_loss
      FROM rs r JOIN full_ f ON r.participant_id = f.participant_id AND r.model_family = f.model_family WHERE r.model_family <> 'majority' GROUP BY r.participant_id, fraction, rep),
    ra AS (SELECT participant_id, fraction, avg(d_ba) AS r_ba, avg(d_brier) AS r_brier, avg(d_log_loss) AS r_log_loss, count(d_ba) AS k, stddev_samp(d_ba) AS sd FROM rd GROUP BY participant_id, fraction),
    ev AS (SELECT DISTINCT participant_id, fraction FROM pl, fr)
    SELECT ev.participant_id, ev.fraction, d_ba - r_ba AS c_ba, d_brier - r_brier AS c_brier, d_log_loss - r_log_loss AS c_log_loss, coalesce(k, 0) / {DRAWS}.0::DOUBLE - CAST(d_ba IS NOT NULL AS DOUBLE) AS c_estimable,
      coalesce(k, 0) AS n_random_estimable, CASE WHEN sd IS NOT NULL THEN sd / sqrt(k) END AS mcse_ba, sqrt(coalesce(k, 0) / {DRAWS}.0::DOUBLE * (1 - coalesce(k, 0) / {DRAWS}.0::DOUBLE) / {DRAWS}.0::DOUBLE) AS se_estimable
    FROM ev LEFT JOIN d ON d.participant_id = ev.participant_id AND d.fraction = ev.fraction LEFT JOIN ra ON ra.participant_id = ev.participant_id AND ra.fraction = ev.fraction""",
    "c_ba c_brier c_log_loss c_estimable mcse_ba se_estimable",
)
def contrast_of_digest_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``observation_contrast`` with draws by digests of names in place of seeded generators."""
    full = observe.full_metrics(rows(spark, sf_dir))
    r = observe.distortion(observe.observed_metrics(_drawn(spark, sf_dir), rows(spark, sf_dir), ["fraction", "rep"]), full, ["fraction", "rep"])
    return observe.contrast(observe.distortion(_targeted(spark, sf_dir), full, ["fraction"]), r, DRAWS, observe.budgets(scores(spark, sf_dir)))


@query(
    "audit_mixture",
    f"""{_RANKED}, {_DRAWN}, bu AS (SELECT DISTINCT participant_id, fraction, CAST(floor(CAST(fraction AS DOUBLE) * n) AS INTEGER) AS budget FROM pl, fr), ba AS (SELECT *, CAST(floor(0.3::DOUBLE * budget) AS INTEGER) AS audit FROM bu),
    au AS (SELECT participant_id, fraction, window_id FROM (SELECT dm.participant_id, dm.fraction, window_id, audit, row_number() OVER (PARTITION BY dm.participant_id, dm.fraction ORDER BY sha256(window_id), window_id) AS r
      FROM dm JOIN ba ON ba.participant_id = dm.participant_id AND ba.fraction = dm.fraction WHERE rep = 0) WHERE r <= audit),
    re AS (SELECT participant_id, fraction, window_id FROM (SELECT ba.participant_id, ba.fraction, cs.window_id, budget - audit AS room, row_number() OVER (PARTITION BY ba.participant_id, ba.fraction ORDER BY round(consensus_score, 12) DESC, sha256(cs.window_id)) AS r
      FROM ba JOIN cs ON cs.participant_id = ba.participant_id WHERE NOT EXISTS (SELECT 1 FROM au WHERE au.participant_id = ba.participant_id AND au.fraction = ba.fraction AND au.window_id = cs.window_id)) WHERE r <= room)
    SELECT * FROM au UNION ALL SELECT * FROM re""",
)
def audit_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scores(spark, sf_dir)
    order = observe.consensus(p).select("participant_id", "window_id", F.struct(-F.round("consensus_score", 12), F.sha2("window_id", 256)).alias("place"))
    return observe.audit_mixture(observe.targeted_mask(p), _drawn(spark, sf_dir, 1).drop("rep"), observe.budgets(p), order, 0.3)


_WEIGHTS = "(SELECT unnest(['None', 'balanced']) AS w, unnest([0, 1]) AS iw)"


@query(
    "candidate_ids",
    f"""SELECT 'logistic' AS family, CAST(ic * 2 + iw AS INTEGER) AS position, 'logistic:C=' || c || ',class_weight=' || w AS candidate_id, '{{"C": ' || c || ', "class_weight": ' || CASE w WHEN 'None' THEN 'null' ELSE '"balanced"' END || '}}' AS params
      FROM (SELECT unnest(['0.1', '1.0', '10.0']) AS c, unnest([0, 1, 2]) AS ic), {_WEIGHTS}
    UNION ALL SELECT 'random_forest', CAST(id * 4 + il * 2 + iw AS INTEGER), 'random_forest:max_depth=' || d || ',min_samples_leaf=' || l || ',class_weight=' || w,
      '{{"class_weight": ' || CASE w WHEN 'None' THEN 'null' ELSE '"balanced"' END || ', "max_depth": ' || d || ', "min_samples_leaf": ' || l || '}}'
      FROM (SELECT unnest([3, 6]) AS d, unnest([0, 1]) AS id), (SELECT unnest([5, 2]) AS l, unnest([0, 1]) AS il), {_WEIGHTS}
    UNION ALL SELECT 'xgboost', CAST(id * 4 + ir * 2 + im AS INTEGER), 'xgboost:max_depth=' || d || ',learning_rate=' || r || ',class_weight_mode=' || m, '{{"class_weight_mode": "' || m || '", "learning_rate": ' || r || ', "max_depth": ' || d || '}}'
      FROM (SELECT unnest([2, 3]) AS d, unnest([0, 1]) AS id), (SELECT unnest(['0.03', '0.1']) AS r, unnest([0, 1]) AS ir), (SELECT unnest(['none', 'training_ratio']) AS m, unnest([0, 1]) AS im)""",
)
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of every family in grid order; no table is read."""
    listed = [(family, c.order, c.candidate_id, c.params_json()) for family, grid in models.GRIDS.items() for c in grid]
    return spark.createDataFrame(listed, "family string, position int, candidate_id string, params string")


@query("family_union", f"{BASE} SELECT participant_id, window_id, model_family, hard, CAST(row_number() OVER (PARTITION BY participant_id, window_id ORDER BY list_position(['logistic', 'random_forest', 'xgboost', 'majority'], model_family)) - 1 AS INTEGER) AS place FROM predictions")
def family_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families' rows, put together one family after the other in canonical order."""
    made, out = predictions(spark, sf_dir), None
    for place, family in enumerate([*FAMILIES, "majority"]):
        mine = made.filter(F.col("model_family") == family).select("participant_id", "window_id", "model_family", "hard", F.lit(place).alias("place"))
        out = mine if out is None else out.unionByName(mine)
    return out


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir).select("participant_id").distinct()


_FOLDS = f"""WITH {WINDOWS}, p AS (SELECT DISTINCT participant_id, CAST(substr(participant_id, 2) AS INTEGER) AS n FROM windows), o AS (SELECT participant_id, CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS fold_index FROM p),
folds AS (SELECT o.participant_id AS outer_participant, fold_index, p.participant_id, CASE WHEN p.participant_id = o.participant_id THEN 'test' ELSE 'train' END AS part FROM o, p)"""


@query("lopo_folds", f"{_FOLDS} SELECT * FROM folds")
def lopo_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.lopo_folds(participants(spark, sf_dir))


@query(
    "fold_cover_check",
    f"""{_FOLDS}, planted AS (SELECT * FROM folds WHERE outer_participant NOT LIKE '%3' UNION ALL SELECT * FROM folds WHERE outer_participant LIKE '%7'),
    n AS (SELECT participant_id, count(*) AS n FROM planted WHERE part = 'test' GROUP BY participant_id)
    SELECT p.participant_id, coalesce(n.n, 0) AS n FROM p LEFT JOIN n ON p.participant_id = n.participant_id WHERE coalesce(n.n, 0) <> 1""",
)
def fold_cover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted faults: the folds of participants whose id ends with 3 are lost, those of ids ending with 7 are there twice."""
    folds = splits.lopo_folds(participants(spark, sf_dir))
    planted = folds.filter("outer_participant NOT LIKE '%3'").unionByName(folds.filter("outer_participant LIKE '%7'"))
    return splits.cover_violations(planted, participants(spark, sf_dir))


@query("split_overlap", f"WITH {WINDOWS} SELECT participant_id FROM windows GROUP BY participant_id HAVING count(*) FILTER (y = 0) > 0 AND count(*) FILTER (y = 1) > 0")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants that are on both sides of a split by class, which is no split by participant."""
    rows_ = labels(spark, sf_dir)
    return splits.overlapping(rows_.filter("y = 0"), rows_.filter("y = 1"))


@query("inner_folds")
def inner_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.inner_folds(models.class_counts(labels(spark, sf_dir)))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant_id, window_id, y and four numeric features, one of them with gaps, one without values."""
    w = windows(spark, sf_dir)
    return w.select(
        "participant_id", "window_id", "y", F.col("n_chars").cast("double").alias("a"), F.when(F.col("n_chars") > 500, (F.col("doc_id") % 17).cast("double")).alias("b"),
        F.lit(None).cast("double").alias("c"), F.sqrt(F.col("n_chars").cast("double")).alias("d"),
    )


_TRAIN = f"WITH {WINDOWS}, t AS (SELECT *, CAST(n_chars AS DOUBLE) AS a, CASE WHEN n_chars > 500 THEN CAST(doc_id % 17 AS DOUBLE) END AS b, sqrt(CAST(n_chars AS DOUBLE)) AS d FROM windows WHERE y IS NOT NULL AND participant_id <> 'S3')"


@query("training_medians", f"{_TRAIN} SELECT quantile_cont(a, 0.5) AS a, quantile_cont(b, 0.5) AS b, 0.0::DOUBLE AS c, quantile_cont(d, 0.5) AS d, 'c' AS all_missing FROM t", "a b c d")
def training_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = training_rows(spark, sf_dir).filter("y IS NOT NULL AND participant_id <> 'S3'")
    return models.training_medians(train, ["a", "b", "c", "d"]).withColumn("all_missing", F.array_join("all_missing", ","))


@query("training_scaler", f"{_TRAIN} SELECT avg(a) AS mean_a, stddev_pop(a) AS std_a, avg(b) AS mean_b, stddev_pop(b) AS std_b, avg(d) AS mean_d, stddev_pop(d) AS std_d FROM t", "mean_a std_a mean_b std_b mean_d std_d")
def training_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.training_scaler(training_rows(spark, sf_dir).filter("y IS NOT NULL AND participant_id <> 'S3'"), ["a", "b", "d"])


@query("majority_baseline", f"WITH {WINDOWS} SELECT participant_id, avg(y) AS prevalence, CAST(avg(y) > 0.5 AS TINYINT) AS majority_label FROM windows WHERE y IS NOT NULL GROUP BY participant_id", "prevalence")
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.majority_baseline(labels(spark, sf_dir).filter("y IS NOT NULL"), ["participant_id"])


@query("class_ratio", f"WITH {WINDOWS} SELECT count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) / count(*) FILTER (y = 1) AS ratio FROM windows", "ratio")
def class_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.class_ratio(labels(spark, sf_dir))


@query("prediction_faults", f"""WITH {WINDOWS}
    SELECT 'missing' AS fault, 'logistic' AS model_family, count(*) FILTER (n_chars < 300) AS n FROM windows UNION ALL SELECT 'repeated', 'xgboost', count(*) FILTER (n_chars > 4000) FROM windows
    UNION ALL SELECT 'not_finite', 'random_forest', count(*) FILTER (n_chars BETWEEN 1000 AND 1200) FROM windows""")
def prediction_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted faults: gaps in one family, repeats in another, non-finite values in the third."""
    w = windows(spark, sf_dir)
    p = predictions(spark, sf_dir).filter("model_family <> 'majority'").join(w.select("window_id", "n_chars"), "window_id")
    p = p.filter("NOT (model_family = 'logistic' AND n_chars < 300)")
    odd = F.when((F.col("model_family") == "random_forest") & F.col("n_chars").between(1000, 1200), F.lit(float("nan"))).otherwise(F.col("prob_positive"))
    p = p.withColumn("prob_positive", odd)
    p = p.unionByName(p.filter("model_family = 'xgboost' AND n_chars > 4000"))
    return models.prediction_faults(p, w, FAMILIES)


@query("oof_predictions")
def oof_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every participant left out once, all candidates compared inside, every window predicted; ensembles of ``models.TREES`` and ``models.ROUNDS``.

    Sources of one class only, as these tables may have, count for no inner score.
    """
    return task_models.out_of_fold_predictions(training_rows(spark, sf_dir), ["a", "b", "d"], [*FAMILIES, "majority"], skip_single_class=True)
