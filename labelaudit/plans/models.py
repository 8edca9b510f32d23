"""Queries around fitted models. MLlib scores have no SQL form, so these have no oracle;
tests check them against closed properties instead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from labelaudit.functions.expressions import binarize
from labelaudit.operators import classifier as L, confident as C, features as X, review as W
from labelaudit.operators.assemble import assemble_and_dedupe
from labelaudit.operators.metrics import compare_variants
from labelaudit.operators.profile import class_weights, positive_rate
from labelaudit.operators.split import stratified_split
from labelaudit.plans import views as V
from labelaudit.plans.registry import query, r6
from labelaudit.plans.reviews import _FLAGGED, _JOINT, _RATES
from labelaudit.plans.vectors import _PACKED, _POOLED, _WORDS, _doc_vectors, _knn_sql, _near_sql, _pooled, near_texts
from labelaudit.session import store
from labelaudit.sources.tables import read_table


def _vector_rows(spark, sf) -> DataFrame:
    """The given vectors with a two-class label."""
    rows = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") % 2).cast("int").alias("label"), "embedding"
    )
    return L.as_features(rows, "embedding").drop("embedding")


def _text_rows(spark, sf) -> tuple[DataFrame, object]:
    """Labelled documents with hashed token features, and the feature model."""
    texts = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("content")
    )
    labels = read_table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("quality").alias("label")
    )
    docs = texts.join(labels, "row_id")
    model = X.fit_text_features(docs, "content", 1 << 12)
    return store(X.text_features(docs, model, "content").drop("content"), "features"), model


@query("text_features")
def text_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows, _ = _text_rows(spark, sf)
    nonzero = F.size(F.filter(vector_to_array("features"), lambda x: x != 0))
    return rows.select("row_id", "label", nonzero.alias("n_features"))


@query("classifier_scores")
def classifier_scores(spark, sf):
    """Class-weighted fit on text features, until it converges; scores of the same rows."""
    rows, _ = _text_rows(spark, sf)
    model = L.fit_classifier(rows, weights=class_weights(rows))
    return L.score(rows, model).select("row_id", "label", "predicted_label", F.round("probability", 3).alias("probability"))


@query("oof_scores")
def oof_scores(spark, sf):
    out = L.out_of_fold(_vector_rows(spark, sf))
    return out.select("row_id", "label", "fold", F.round(F.get("p", F.lit(1)), 3).alias("p1"))


@query("oof_label_issues")
def oof_label_issues(spark, sf):
    """Out-of-fold scores handed to confident learning."""
    scored = store(L.out_of_fold(_vector_rows(spark, sf)), "oof")
    out = C.label_issues(scored)
    return out.select("row_id", "given_label", "suggested_label", F.round("label_score", 3).alias("label_score"), "is_label_issue")


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    parts = stratified_split(rows, frac=0.2).select("row_id", "split")
    stored = store(rows.join(parts, "row_id"), "halves")
    return stored.where("split = 'train'"), stored.where("split = 'val'")


_GRID = [{"c": c, "max_iter": m} for c in (0.1, 1.0, 10.0) for m in (20.0, 100.0)]


@query("grid_trials")
def grid_trials(spark, sf):
    train, val = _halves(_vector_rows(spark, sf))
    return L.grid_search(train, val, _GRID)


@query("grid_refit")
def grid_refit(spark, sf):
    """The grid, then the three best settings fitted again."""
    train, val = _halves(_vector_rows(spark, sf))
    return L.refit_top(L.grid_search(train, val, _GRID), train, val, 3)[1]


def _external(spark, sf, features) -> DataFrame:
    rows = V.external(spark, sf).withColumn("true_label", binarize("label", "coded"))
    return X.text_features(rows, features, "content").select("row_id", "true_label", "features")


@query("score_benchmark")
def score_benchmark(spark, sf):
    rows, features = _text_rows(spark, sf)
    model = L.fit_classifier(rows, weights=class_weights(rows), max_iter=100)
    scored = L.score(_external(spark, sf, features), model)
    return scored.select("row_id", "true_label", "predicted_label", F.round("probability", 3).alias("probability"))


@query("external_report")
def external_report(spark, sf):
    rows, features = _text_rows(spark, sf)
    model = L.fit_classifier(rows, weights=class_weights(rows), max_iter=100)
    out = L.external_eval(_external(spark, sf, features), model)
    return out.select("class", *[F.round(c, 3).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("cluster_performance")
def cluster_performance(spark, sf):
    """Mean self-confidence per k-means cluster of the document vectors."""
    vectors = _doc_vectors(spark, sf).where("vector IS NOT NULL")
    vectors = store(vectors.join(V.scores(spark, sf), "row_id"), "clusters")
    out = C.group_performance(C.cluster_groups(vectors, "vector", 5), "cluster")
    return out.select("cluster", "n", r6("mean_score"), r6("relative"))


def correction_rates(spark, sf) -> DataFrame:
    """The whole chain: assemble, score, flag, review, correct; positive share per category.

    Copies are removed first; vectors, near copies, scores and suspects come from the
    rows that are left.
    """
    corpus = V.corpus(spark, sf).select("row_id", "content", "term", "ingroup", "label", "n_chars")
    assembled = store(assemble_and_dedupe([corpus]), "assembled")
    texts = assembled.select("row_id", F.col("content").alias("text"))
    scored = V.scores(spark, sf).join(assembled.select("row_id"), "row_id", "left_semi")
    suspects = store(C.suspects(scored).join(texts, "row_id"), "suspects")
    near = near_texts(store(_pooled(spark, sf, assembled), "kept-vectors")).where("is_near_duplicate")
    copies = store(near.select("row_id").join(texts, "row_id"), "copies")
    corrected = W.corrected_corpus(assembled, V.reviewed(spark, sf), suspects, copies)
    before = positive_rate(assembled, by=["term"]).withColumnRenamed("positive_rate", "rate_before")
    after = positive_rate(corrected, by=["term"]).withColumnRenamed("positive_rate", "rate_after")
    return before.join(after, "term", "left").select("term", r6("rate_before"), r6("rate_after"))


query(
    "correction_rates",
    V.CORPUS,
    V.PREDS,
    V.REVIEWED.removeprefix(f"{V.BASE}, "),
    """kept AS (
  SELECT row_id, content, term, coalesce(label, 1) AS label FROM (
    SELECT *, row_number() OVER (PARTITION BY content ORDER BY row_id) AS rn FROM corpus WHERE content IS NOT NULL)
  WHERE rn = 1),
scores AS (
  SELECT row_id, term, true_label AS label, 1 - probability AS p0, probability AS p1
  FROM preds WHERE model = 'a' AND row_id IN (SELECT row_id FROM kept))""",
    _JOINT,
    _RATES,
    _FLAGGED,
    _WORDS,
    _POOLED,
    _PACKED,
    "kept_vectors AS (SELECT row_id, v FROM packed WHERE row_id IN (SELECT row_id FROM kept))",
    _knn_sql("kept_vectors"),
    _near_sql(0.13),
    """valid AS (
  SELECT * FROM reviewed WHERE NOT COALESCE(regexp_matches(reviewer_notes, '(?i)remove'), FALSE)
    AND NOT COALESCE(regexp_matches(reviewer_notes, '(?i)unsure|usure'), FALSE)),
latest AS (
  SELECT text, final_label FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY review_date DESC, final_label DESC) AS rn FROM valid) WHERE rn = 1),
gone AS (
  SELECT k.row_id FROM kept k JOIN flagged f ON k.row_id = f.row_id WHERE k.content NOT IN (SELECT text FROM valid)
  UNION SELECT row_id FROM near WHERE is_near_duplicate),
corrected AS (
  SELECT k.term, COALESCE(l.final_label, k.label) AS label FROM kept k LEFT JOIN latest l ON k.content = l.text
  WHERE k.row_id NOT IN (SELECT row_id FROM gone))""",
    """SELECT b.term, b.rate AS rate_before, a.rate AS rate_after
       FROM (SELECT term, round(avg(label), 6) AS rate FROM kept GROUP BY term) b
       LEFT JOIN (SELECT term, round(avg(label), 6) AS rate FROM corrected GROUP BY term) a ON a.term = b.term""",
)(correction_rates)


# --- fits against closed properties ------------------------------------------------------------

# With an intercept that no penalty touches, the mean fitted probability of the rows
# a model was fitted on equals the (weighted) share of positives.


@query(
    "fit_mean_probability",
    "rows_ AS (SELECT label % 2 AS label FROM embeddings)",
    """SELECT 'plain' AS fit, round(avg(label) + 0.00001, 3) AS mean_p FROM rows_
       UNION ALL SELECT 'balanced', round(CAST(0.50001 AS DOUBLE), 3)""",
)
def fit_mean_probability(spark, sf):
    """Plain and class-weighted fits on the given vectors."""
    rows = store(_vector_rows(spark, sf), "rows")
    weights = class_weights(rows)
    plain = L.score(rows, L.fit_classifier(rows)).agg(F.avg("probability").alias("p"))
    weighted = L.score(rows, L.fit_classifier(rows, weights=weights)).join(weights, "label")
    weighted = weighted.agg((F.sum(F.col("probability") * F.col("weight")) / F.sum("weight")).alias("p"))
    one = plain.select(F.lit("plain").alias("fit"), F.round(F.col("p") + 0.00001, 3).alias("mean_p"))
    return one.unionByName(weighted.select(F.lit("balanced").alias("fit"), F.round(F.col("p") + 0.00001, 3).alias("mean_p")))


_FOLDS = """folds AS (
  SELECT vec_id AS row_id, label % 2 AS label,
         CAST((row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR))) - 1) % 5 AS INTEGER) AS fold FROM embeddings)"""


@query("oof_folds", _FOLDS, "SELECT row_id, CAST(label AS INTEGER) AS label, fold FROM folds")
def oof_folds(spark, sf):
    """Every row is scored once, in its fold."""
    return L.out_of_fold(_vector_rows(spark, sf)).where("p IS NOT NULL").select("row_id", "label", "fold")


@query(
    "fold_mean_probability",
    _FOLDS,
    """SELECT f.fold, round(avg(o.label) + 0.00001, 3) AS mean_p FROM (SELECT DISTINCT fold FROM folds) f
       JOIN folds o ON o.fold <> f.fold GROUP BY f.fold""",
)
def fold_mean_probability(spark, sf):
    """The model of each fold on the rows it was fitted on."""
    from labelaudit.operators.split import fold_assignment

    rows = _vector_rows(spark, sf)
    folds = store(rows.join(fold_assignment(rows), "row_id"), "folds")
    parts = []
    for fold in range(5):
        seen = folds.where(F.col("fold") != fold)
        mean = L.score(seen, L.fit_classifier(seen)).agg(F.round(F.avg("probability") + 0.00001, 3).alias("mean_p"))
        parts.append(mean.select(F.lit(fold).alias("fold"), "mean_p"))
    return reduce(DataFrame.unionByName, parts)


_GRID_SQL = """SELECT * FROM (VALUES (1, CAST(0.1 AS DOUBLE), CAST(20 AS DOUBLE)), (2, 0.1, 100), (3, 1, 20), (4, 1, 100), (5, 10, 20), (6, 10, 100)) t(trial, c, max_iter)"""


@query("grid_settings", f"settings AS ({_GRID_SQL})",
       """SELECT trial, c, max_iter, CAST(0 AS BIGINT) AS n_failed, (SELECT count(*) FROM embeddings) AS n_rows FROM settings""")
def grid_settings(spark, sf):
    """Every setting is tried once, on all rows, and none fails."""
    train, val = _halves(_vector_rows(spark, sf))
    trials = L.grid_search(train, val, _GRID)
    failed = F.col("error").isNotNull() | F.isnan("f1")
    n = train.count() + val.count()
    return trials.select("trial", "c", "max_iter", failed.cast("bigint").alias("n_failed"), F.lit(n).cast("bigint").alias("n_rows"))


@query("external_support", V.EXTERNAL,
       """SELECT CASE WHEN label = 'coded' THEN 1 ELSE 0 END AS class, count(*) AS support FROM external GROUP BY 1""")
def external_support(spark, sf):
    """The external report counts every row of the external set once."""
    return external_report(spark, sf).where("support > 0").select("class", "support")


def _held_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Four fifths and one fifth of the rows, by hash."""
    held = F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0
    return rows.where(~held), rows.where(held)


@query("before_after_correction")
def before_after_correction(spark, sf):
    """Fits on the given and on the corrected labels, each measured on held-out rows.

    The held-out labels are the corrected ones for both, so the difference is what the
    corrections are worth. Reviewed texts only are corrected; a text is on one side.
    """
    docs = V.corpus(spark, sf).where("label IS NOT NULL").select("row_id", "content", "label")
    docs = store(assemble_and_dedupe([docs]).select("row_id", "content", "label"), "labelled")
    model = X.fit_text_features(docs, "content", 1 << 12)
    features = store(X.text_features(docs, model, "content").select("row_id", "features"), "features")
    fixed = W.apply_corrections(docs, W.usable(V.reviewed(spark, sf))).select("row_id", F.col("label").alias("fixed"))
    rows = features.join(docs.select("row_id", "label"), "row_id").join(fixed, "row_id")
    train, held = _held_out(store(rows, "both-labels"))
    parts = []
    for variant, label in (("given", "label"), ("corrected", "fixed")):
        own = train.select("row_id", "features", F.col(label).alias("label"))
        fit = L.fit_classifier(own, weights=class_weights(own), max_iter=100)
        scored = L.score(held.withColumnRenamed("fixed", "true_label"), fit)
        parts.append(scored.select(F.lit(variant).alias("variant"), "row_id", "true_label", "predicted_label", "probability"))
    return compare_variants(reduce(DataFrame.unionByName, parts), "variant", "given", "corrected")
