"""Metrics of prediction tables, runs and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.operators import metrics as M, tracking as K
from labelaudit.operators.profile import class_weights
from labelaudit.plans import views as V
from labelaudit.plans.registry import query, r6

BY = ["model", "dataset"]


def decided(spark, sf):
    return M.with_decision(V.preds(spark, sf))


@query(
    "confusion_matrix",
    V.DECIDED,
    """SELECT m.model, m.dataset, t.v AS true_label, p.v AS predicted_label,
              (SELECT count(*) FROM decided d WHERE d.model = m.model AND d.dataset = m.dataset
                 AND d.true_label = t.v AND d.predicted_label = p.v) AS n
       FROM (SELECT DISTINCT model, dataset FROM decided) m, (SELECT unnest([0, 1]) AS v) t, (SELECT unnest([0, 1]) AS v) p""",
)
def confusion_matrix(spark, sf):
    return M.confusion(decided(spark, sf), BY)


_QUADRANTS = """q AS (
  SELECT model, dataset,
         CAST(count(*) FILTER (WHERE true_label = 1 AND predicted_label = 1) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE true_label = 0 AND predicted_label = 1) AS DOUBLE) AS fp,
         CAST(count(*) FILTER (WHERE true_label = 1 AND predicted_label = 0) AS DOUBLE) AS fn,
         CAST(count(*) FILTER (WHERE true_label = 0 AND predicted_label = 0) AS DOUBLE) AS tn
  FROM decided GROUP BY model, dataset)"""


def _ratio(top: str, bottom: str) -> str:
    return f"COALESCE(({top}) / NULLIF({bottom}, 0), 0)"


_BINARY = f"""binary_scores AS (
  SELECT model, dataset, tp, fp, fn, tn, {_ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy,
         {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall,
         {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1,
         ({_ratio('tp', 'tp + fn')} + {_ratio('tn', 'tn + fp')}) / 2 AS balanced_accuracy FROM q)"""


@query(
    "binary_metrics",
    V.DECIDED,
    _QUADRANTS,
    _BINARY,
    """SELECT model, dataset, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
              CAST(tn AS BIGINT) AS tn, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
              round(recall, 6) AS recall, round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy
       FROM binary_scores""",
)
def binary_metrics(spark, sf):
    out = M.binary_metrics(decided(spark, sf), BY)
    names = ("accuracy", "precision", "recall", "f1", "balanced_accuracy")
    return out.select(*BY, "tp", "fp", "fn", "tn", *[r6(c) for c in names])


_REPORT = f"""sides AS (
  SELECT model, dataset, true_label AS class, 1 AS s, 0 AS p, CASE WHEN true_label = predicted_label THEN 1 ELSE 0 END AS t FROM decided
  UNION ALL SELECT model, dataset, predicted_label, 0, 1, 0 FROM decided),
sums AS (
  SELECT model, dataset, class, CAST(sum(s) AS DOUBLE) AS support, CAST(sum(p) AS DOUBLE) AS predicted,
         CAST(sum(t) AS DOUBLE) AS tp FROM sides GROUP BY model, dataset, class),
report AS (
  SELECT model, dataset, class, {_ratio('tp', 'predicted')} AS precision, {_ratio('tp', 'support')} AS recall,
         {_ratio('2 * tp', 'predicted + support')} AS f1, CAST(support AS BIGINT) AS support FROM sums)"""


@query(
    "class_report",
    V.DECIDED,
    _REPORT,
    """SELECT model, dataset, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
              round(f1, 6) AS f1, support FROM report""",
)
def class_report(spark, sf):
    out = M.class_report(decided(spark, sf), BY)
    return out.select(*BY, "class", *[r6(c) for c in ("precision", "recall", "f1")], "support")


_AVERAGES = """averages AS (
  SELECT model, dataset, 'macro avg' AS average, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1,
         CAST(sum(support) AS BIGINT) AS support FROM report GROUP BY model, dataset
  UNION ALL
  SELECT model, dataset, 'weighted avg', CAST(sum(precision * support) AS DOUBLE) / CAST(sum(support) AS DOUBLE),
         CAST(sum(recall * support) AS DOUBLE) / CAST(sum(support) AS DOUBLE),
         CAST(sum(f1 * support) AS DOUBLE) / CAST(sum(support) AS DOUBLE),
         CAST(sum(support) AS BIGINT) FROM report GROUP BY model, dataset)"""


@query(
    "class_report_avg",
    V.DECIDED,
    _REPORT,
    _AVERAGES,
    """SELECT model, dataset, average, round(precision, 6) AS precision, round(recall, 6) AS recall,
              round(f1, 6) AS f1, support FROM averages""",
)
def class_report_avg(spark, sf):
    out = M.class_report_avg(decided(spark, sf), BY)
    return out.select(*BY, "average", *[r6(c) for c in ("precision", "recall", "f1")], "support")


_BY_SCORE = """by_score AS (
  SELECT model, dataset, probability, CAST(sum(true_label) AS DOUBLE) AS pos, CAST(sum(1 - true_label) AS DOUBLE) AS neg
  FROM preds GROUP BY model, dataset, probability)"""


@query(
    "roc_curve",
    V.PREDS,
    _BY_SCORE,
    """SELECT model, dataset, round(probability, 6) AS threshold,
              round(sum(neg) OVER w / sum(neg) OVER (PARTITION BY model, dataset), 6) AS fpr,
              round(sum(pos) OVER w / sum(pos) OVER (PARTITION BY model, dataset), 6) AS tpr
       FROM by_score WINDOW w AS (PARTITION BY model, dataset ORDER BY probability DESC
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
       UNION ALL SELECT DISTINCT model, dataset, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM preds""",
)
def roc_curve(spark, sf):
    out = M.roc_curve(V.preds(spark, sf), BY)
    return out.select(*BY, r6("threshold"), r6("fpr"), r6("tpr"))


_AUC = """auc AS (
  SELECT model, dataset, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (
    SELECT *, sum(neg) OVER (PARTITION BY model, dataset ORDER BY probability
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg AS below FROM by_score)
  GROUP BY model, dataset)"""


@query("roc_auc", V.PREDS, _BY_SCORE, _AUC, "SELECT model, dataset, round(auc, 6) AS auc FROM auc")
def roc_auc(spark, sf):
    return M.roc_auc(V.preds(spark, sf), BY).select(*BY, r6("auc"))


_PAIRED = """paired AS (SELECT a.row_id, a.true_label, a.probability AS a, b.probability AS b
  FROM preds a JOIN preds b ON a.row_id = b.row_id WHERE a.model = 'a' AND b.model = 'b'),
wins AS (
  SELECT p.row_id AS p, n.row_id AS n, CASE WHEN p.a > n.a THEN 1.0 WHEN p.a = n.a THEN 0.5 ELSE 0.0 END AS a,
         CASE WHEN p.b > n.b THEN 1.0 WHEN p.b = n.b THEN 0.5 ELSE 0.0 END AS b
  FROM paired p, paired n WHERE p.true_label = 1 AND n.true_label = 0),
areas AS (
  SELECT avg(a)::DOUBLE AS auc_baseline, avg(b)::DOUBLE AS auc_candidate FROM wins),
errors AS (
  SELECT sqrt((SELECT var_samp(d) / count(*) FROM (SELECT avg(b)::DOUBLE - avg(a)::DOUBLE AS d FROM wins GROUP BY p))
            + (SELECT var_samp(d) / count(*) FROM (SELECT avg(b)::DOUBLE - avg(a)::DOUBLE AS d FROM wins GROUP BY n))) AS error),
tested AS (SELECT *, (auc_candidate - auc_baseline) / error AS z, abs(z) / sqrt(2.0::DOUBLE) AS x, 1 / (1 + 0.3275911::DOUBLE * x) AS t
  FROM areas, errors)"""


@query(
    "auc_difference",
    V.PREDS,
    _PAIRED,
    """SELECT round(auc_baseline, 6) AS auc_baseline, round(auc_candidate, 6) AS auc_candidate,
              round(auc_candidate - auc_baseline, 6) AS difference, round(error, 6) AS error, round(z, 6) AS z,
              round(least(1.0::DOUBLE, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE
                + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x)), 6) AS p_value FROM tested""",
)
def auc_difference(spark, sf):
    """Whether two models that score the same rows differ in area by more than chance."""
    found = M.compare_auc(V.preds(spark, sf), "model", "a", "b")
    return found.select(*[r6(c) for c in found.columns])


_REPLICATES = 40
_RESAMPLED = f"""drawn AS (
  SELECT model, replicate, true_label, predicted_label,
         list_sum(list_transform({M.POISSON}, lambda s: (CAST('0x' || substr(md5(row_id::VARCHAR || ':' || replicate::VARCHAR), 1, 8) AS BIGINT) >= s)::BIGINT)) AS w
  FROM decided, (SELECT unnest(range({_REPLICATES})) AS replicate)),
resampled AS (
  SELECT model, replicate, coalesce(sum(w) FILTER (true_label = 0 AND predicted_label = 0), 0)::BIGINT AS tn,
         coalesce(sum(w) FILTER (true_label = 0 AND predicted_label = 1), 0)::BIGINT AS fp,
         coalesce(sum(w) FILTER (true_label = 1 AND predicted_label = 0), 0)::BIGINT AS fn,
         coalesce(sum(w) FILTER (true_label = 1 AND predicted_label = 1), 0)::BIGINT AS tp FROM drawn GROUP BY model, replicate)"""


@query("bootstrap_counts", V.DECIDED, _RESAMPLED, "SELECT model, CAST(replicate AS INTEGER) AS replicate, tn, fp, fn, tp FROM resampled")
def bootstrap_counts(spark, sf):
    return M.bootstrap_counts(decided(spark, sf), "model", _REPLICATES)


@query(
    "bootstrap_interval",
    V.DECIDED,
    _RESAMPLED,
    """figures AS (SELECT model, replicate, (tn + tp) / (tn + fp + fn + tp) AS accuracy, 2 * tp / (2 * tp + fp + fn) AS f1 FROM resampled),
       long AS (SELECT model, replicate, 'accuracy' AS metric, accuracy AS v FROM figures UNION ALL SELECT model, replicate, 'f1', f1 FROM figures),
       gains AS (SELECT a.metric, b.v - a.v AS gain FROM long a JOIN long b USING (metric, replicate) WHERE a.model = 'a' AND b.model = 'b')""",
    """SELECT metric, round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.5), 6) AS median,
              round(quantile_cont(gain, 0.975), 6) AS high FROM gains GROUP BY metric""",
)
def bootstrap_interval(spark, sf):
    """What model b gains over model a, with an interval from paired resamples."""
    found = M.bootstrap_interval(decided(spark, sf), "model", "a", "b", _REPLICATES)
    return found.select("metric", r6("low"), r6("median"), r6("high"))


@query(
    "weighted_log_loss",
    V.PREDS,
    """w AS (SELECT quality AS true_label, CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight
            FROM base GROUP BY quality)""",
    """SELECT model, round(sum(weight * nll) / sum(weight), 6) AS log_loss FROM (
         SELECT model, w.weight, -CASE WHEN p.true_label = 1 THEN ln(c) ELSE ln(1 - c) END AS nll
         FROM (SELECT *, greatest(1e-15, least(1 - 1e-15, probability)) AS c FROM preds) p
         JOIN w ON p.true_label = w.true_label) GROUP BY model""",
)
def weighted_log_loss(spark, sf):
    labelled = V.base(spark, sf).select(F.col("quality").alias("true_label"))
    weights = class_weights(labelled, "true_label")
    return M.log_loss(V.preds(spark, sf), weights, ["model"]).select("model", r6("log_loss"))


_SUMMARY = """
  SELECT model, dataset, 'accuracy' AS metric, CAST(NULL AS VARCHAR) AS class, accuracy AS value FROM binary_scores
  UNION ALL SELECT model, dataset, 'auc', NULL, auc FROM auc
  UNION ALL SELECT model, dataset, 'precision', CAST(class AS VARCHAR), precision FROM report
  UNION ALL SELECT model, dataset, 'recall', CAST(class AS VARCHAR), recall FROM report
  UNION ALL SELECT model, dataset, 'f1', CAST(class AS VARCHAR), f1 FROM report
  UNION ALL SELECT model, dataset, 'support', CAST(class AS VARCHAR), CAST(support AS DOUBLE) FROM report
  UNION ALL SELECT model, dataset, 'precision', average, precision FROM averages
  UNION ALL SELECT model, dataset, 'recall', average, recall FROM averages
  UNION ALL SELECT model, dataset, 'f1', average, f1 FROM averages
  UNION ALL SELECT model, dataset, 'support', average, CAST(support AS DOUBLE) FROM averages"""


@query(
    "eval_summary",
    V.DECIDED,
    _QUADRANTS,
    _BINARY,
    _BY_SCORE,
    _AUC,
    _REPORT,
    _AVERAGES,
    f'SELECT model, dataset, metric, class, round("value", 6) AS "value" FROM ({_SUMMARY})',
)
def eval_summary(spark, sf):
    out = M.evaluation_summary(decided(spark, sf), BY)
    return out.select(*BY, "metric", "class", r6("value"))


@query(
    "compare_variants",
    V.DECIDED.replace(" AS dataset, doc_id", " AS region, 'all' AS dataset, doc_id"),
    _QUADRANTS,
    _BINARY,
    _BY_SCORE,
    _AUC,
    """long AS (
         SELECT model, 'accuracy' AS metric, accuracy AS v FROM binary_scores
         UNION ALL SELECT model, 'precision', precision FROM binary_scores
         UNION ALL SELECT model, 'recall', recall FROM binary_scores
         UNION ALL SELECT model, 'f1', f1 FROM binary_scores
         UNION ALL SELECT model, 'balanced_accuracy', balanced_accuracy FROM binary_scores
         UNION ALL SELECT model, 'auc', auc FROM auc)""",
    """SELECT metric, round(max(v) FILTER (WHERE model = 'a'), 6) AS baseline,
              round(max(v) FILTER (WHERE model = 'b'), 6) AS candidate,
              round(max(v) FILTER (WHERE model = 'b') - max(v) FILTER (WHERE model = 'a'), 6) AS delta
       FROM long GROUP BY metric""",
)
def compare_variants(spark, sf):
    out = M.compare_variants(decided(spark, sf), "model", "a", "b")
    return out.select("metric", r6("baseline"), r6("candidate"), r6("delta"))


@query(
    "diff_labels",
    V.REVIEWED,
    """SELECT doc_id, 'label' AS column_name, CAST(given_label AS VARCHAR) AS "before", CAST(final_label AS VARCHAR) AS "after"
       FROM reviewed WHERE given_label IS DISTINCT FROM final_label""",
)
def diff_labels(spark, sf):
    """The label column of two versions of one table."""
    rows = V.reviewed(spark, sf)
    before = rows.select("doc_id", F.col("given_label").alias("label"))
    after = rows.select("doc_id", F.col("final_label").alias("label"))
    return M.diff_tables(before, after, "doc_id", ["label"]).drop("one_sided")


# --- runs and trials --------------------------------------------------------------------------


@query(
    "best_step",
    V.LOG,
    """SELECT run, step AS best_step, round(eval_f1, 6) AS best_metric FROM (
         SELECT *, row_number() OVER (PARTITION BY run ORDER BY eval_f1 DESC, step) AS rn FROM log WHERE NOT isnan(eval_f1))
       WHERE rn = 1""",
)
def best_step(spark, sf):
    return K.best_step(V.log(spark, sf), "eval_f1", ["run"]).select("run", "best_step", r6("best_metric"))


@query(
    "log_throughput",
    V.LOG,
    """SELECT run, figure, count(*) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max FROM (
         SELECT run, 'eval_runtime' AS figure, eval_runtime AS v FROM log
         UNION ALL SELECT run, 'eval_samples_per_second', eval_samples_per_second FROM log) GROUP BY run, figure""",
)
def log_throughput(spark, sf):
    out = K.log_throughput(V.log(spark, sf), ["eval_runtime", "eval_samples_per_second"], ["run"])
    return out.select("run", "figure", "n", r6("mean"), r6("min"), r6("max"))


@query(
    "top_trials",
    V.TRIALS,
    """SELECT trial, model, threshold, round(f1, 6) AS f1 FROM trials WHERE NOT isnan(f1) ORDER BY f1 DESC, trial LIMIT 3""",
)
def top_trials(spark, sf):
    return K.top_trials(V.trials(spark, sf), 3).select("trial", "model", "threshold", r6("f1"))


@query(
    "best_trial",
    V.TRIALS,
    """SELECT trial, model, threshold, round(f1, 6) AS f1 FROM trials WHERE NOT isnan(f1) ORDER BY f1 DESC, trial LIMIT 1""",
)
def best_trial(spark, sf):
    return K.best_trial(V.trials(spark, sf)).select("trial", "model", "threshold", r6("f1"))


@query(
    "param_grid",
    V.PREDS,
    """axes AS (SELECT model, dataset, round(probability, 1) AS threshold FROM preds)""",
    """SELECT CAST(row_number() OVER (ORDER BY m.model, d.dataset, t.threshold) AS INTEGER) AS trial,
              m.model, d.dataset, t.threshold FROM (SELECT DISTINCT model FROM axes) m,
              (SELECT DISTINCT dataset FROM axes) d, (SELECT DISTINCT threshold FROM axes) t""",
)
def param_grid(spark, sf):
    """Every setting seen in the predictions, combined."""
    seen = V.preds(spark, sf).select("model", "dataset", F.round("probability", 1).alias("threshold"))
    names = ["model", "dataset", "threshold"]
    # axes hold few values each: two models, two sets, eleven thresholds
    axes = {n: sorted(r[0] for r in seen.select(n).distinct().collect()) for n in names}
    return K.param_grid(spark, axes)
