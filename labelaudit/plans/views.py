"""The given tables in the shapes the operators work on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelaudit.sources.tables import read_table

# --- documents with optional labels -------------------------------------------------

CORPUS = """corpus AS (
  SELECT d.doc_id AS row_id, d.text AS content,
         CASE WHEN d.lang = 'en' THEN 'Informal' ELSE 'Formal' END AS type,
         d.source AS term, d.lang AS ingroup, l.quality AS label, d.n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    kind = F.when(F.col("lang") == "en", "Informal").otherwise("Formal")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("content"),
        kind.alias("type"),
        F.col("source").alias("term"),
        F.col("lang").alias("ingroup"),
        F.col("quality").alias("label"),
        "n_chars",
    )


# --- deterministic scores of two models ---------------------------------------------

BASE = """base AS (
  SELECT d.doc_id, d.text, d.source, d.lang, d.n_chars, l.quality
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

_SQL_A = ("CAST(0.3 AS DOUBLE) * quality + CAST(0.7 AS DOUBLE) * "
          "(CAST((doc_id * 7919 + n_chars * 31) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE))")
_SQL_B = ("CAST(0.4 AS DOUBLE) * quality + CAST(0.6 AS DOUBLE) * "
          "(CAST((doc_id * 104729 + n_chars * 17) % 997 AS DOUBLE) / CAST(997 AS DOUBLE))")
_SQL_SET = "CASE WHEN lang = 'en' THEN 'original' ELSE 'external' END"

PREDS = f"""{BASE}, preds AS (
  SELECT 'a' AS model, {_SQL_SET} AS dataset, doc_id AS row_id, source AS term,
         quality AS true_label, {_SQL_A} AS probability FROM base
  UNION ALL
  SELECT 'b' AS model, {_SQL_SET} AS dataset, doc_id AS row_id, source AS term,
         quality AS true_label, {_SQL_B} AS probability FROM base)"""

DECIDED = f"""{PREDS}, decided AS (
  SELECT *, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS predicted_label FROM preds)"""


def base(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    return documents.join(labels.select("doc_id", "quality"), "doc_id")


def _mix(weight: float, a: int, b: int, modulus: int) -> Column:
    spread = ((F.col("doc_id") * a + F.col("n_chars") * b) % modulus).cast("double")
    return F.lit(weight) * F.col("quality") + F.lit(round(1 - weight, 1)) * (spread / F.lit(float(modulus)))


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Both models from one scan of the tables."""
    models = F.array(
        F.struct(F.lit("a").alias("model"), _mix(0.3, 7919, 31, 1009).alias("probability")),
        F.struct(F.lit("b").alias("model"), _mix(0.4, 104729, 17, 997).alias("probability")),
    )
    return base(spark, sf).select(
        F.when(F.col("lang") == "en", "original").otherwise("external").alias("dataset"),
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("term"),
        F.col("quality").alias("true_label"),
        F.inline(models),
    )


SCORES = f"""{PREDS}, scores AS (
  SELECT row_id, term, true_label AS label, 1 - probability AS p0, probability AS p1
  FROM preds WHERE model = 'a')"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Class probabilities of model a, as confident learning takes them."""
    p = _mix(0.3, 7919, 31, 1009)
    return base(spark, sf).select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("term"),
        F.col("quality").alias("label"),
        F.array(1 - p, p).alias("p"),
    )


# --- review tables --------------------------------------------------------------------

REVIEWED = f"""{BASE}, reviewed AS (
  SELECT doc_id, text, source AS category, quality AS given_label, 1 - quality AS suggested_label,
         CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS final_label,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS review_date,
         CASE WHEN doc_id % 7 = 0 THEN 'Remove' WHEN doc_id % 11 = 0 THEN 'usure about it'
              WHEN doc_id % 13 = 0 THEN NULL ELSE '' END AS reviewer_notes
  FROM base WHERE doc_id % 2 = 0)"""

_MISMATCH = "(CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END)"
SUSPECTS = f"""suspects AS (
  SELECT doc_id, text, source AS category, quality AS given_label, 1 - quality AS suggested_label,
         CASE WHEN quality = 1 THEN probability ELSE 1 - probability END AS label_score
  FROM (SELECT *, {_SQL_A} AS probability FROM base) WHERE {_MISMATCH} <> quality)"""


def _review_date() -> Column:
    return F.timestamp_add("MINUTE", F.col("doc_id"), F.lit("2024-01-01 00:00:00").cast("timestamp"))


def reviewed(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    quality = F.col("quality")
    notes = (
        F.when(doc % 7 == 0, "Remove")
        .when(doc % 11 == 0, "usure about it")
        .when(doc % 13 == 0, F.lit(None).cast("string"))
        .otherwise("")
    )
    return base(spark, sf).where(doc % 2 == 0).select(
        "doc_id",
        "text",
        F.col("source").alias("category"),
        quality.alias("given_label"),
        (1 - quality).alias("suggested_label"),
        F.when(doc % 3 == 0, 1 - quality).otherwise(quality).alias("final_label"),
        _review_date().alias("review_date"),
        notes.alias("reviewer_notes"),
    )


def suspects(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose model-a decision contradicts the label, with their text."""
    p, quality = _mix(0.3, 7919, 31, 1009), F.col("quality")
    return base(spark, sf).where((p >= 0.5).cast("int") != quality).select(
        "doc_id",
        "text",
        F.col("source").alias("category"),
        quality.alias("given_label"),
        (1 - quality).alias("suggested_label"),
        F.when(quality == 1, p).otherwise(1 - p).alias("label_score"),
    )


RAW_DECISIONS = f"""{BASE}, raw AS (
  SELECT doc_id, text, source AS category, quality AS given_label, 1 - quality AS suggested_label,
         CASE doc_id % 5 WHEN 0 THEN 'y' WHEN 1 THEN 'N ' WHEN 2 THEN ' Y' WHEN 3 THEN 'n' ELSE 'maybe' END AS answer,
         CASE doc_id % 4 WHEN 0 THEN '0' WHEN 1 THEN ' 1' WHEN 2 THEN '2' ELSE 'x' END AS new_label,
         '  seen ' AS reviewer_notes, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS review_date
  FROM base)"""


def raw_decisions(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    answer = (
        F.when(doc % 5 == 0, "y").when(doc % 5 == 1, "N ").when(doc % 5 == 2, " Y")
        .when(doc % 5 == 3, "n").otherwise("maybe")
    )
    new_label = F.when(doc % 4 == 0, "0").when(doc % 4 == 1, " 1").when(doc % 4 == 2, "2").otherwise("x")
    return base(spark, sf).select(
        "doc_id",
        "text",
        F.col("source").alias("category"),
        F.col("quality").alias("given_label"),
        (1 - F.col("quality")).alias("suggested_label"),
        answer.alias("answer"),
        new_label.alias("new_label"),
        F.lit("  seen ").alias("reviewer_notes"),
        _review_date().alias("review_date"),
    )


# --- time series ------------------------------------------------------------------------

TREND = """trend AS (
  SELECT o_orderkey AS row_id, o_orderdate AS ts, o_orderpriority AS category,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders)"""

DATED = """dated AS (
  SELECT o_orderkey AS row_id,
         CASE WHEN o_orderkey % 97 = 0 THEN '13/13/2020'
              WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
              ELSE strftime(o_orderdate, '%m/%d/%Y') END AS date_text FROM orders)"""


def trend(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
    )


def dated(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 97 == 0, "13/13/2020")
        .when(F.col("o_orderstatus") == "F", F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "MM/dd/yyyy"))
    )
    return read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), text.alias("date_text"))


# --- runs and trials ----------------------------------------------------------------------

LOG = """log AS (
  SELECT event_type AS run, CAST(day(ts) * 100 AS BIGINT) AS step,
         CASE WHEN day(ts) % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE round(avg(value), 6) END AS eval_f1,
         max(value) AS eval_runtime, CAST(count(*) AS DOUBLE) AS eval_samples_per_second
  FROM events GROUP BY event_type, day(ts))"""


def log(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("ts")
    return (
        read_table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("run"), day.alias("_day"))
        .agg(
            F.round(F.avg("value"), 6).alias("_f1"),
            F.max("value").alias("eval_runtime"),
            F.count("*").cast("double").alias("eval_samples_per_second"),
        )
        .select(
            "run",
            (F.col("_day") * 100).cast("bigint").alias("step"),
            F.when(F.col("_day") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("_f1")).alias("eval_f1"),
            "eval_runtime",
            "eval_samples_per_second",
        )
    )


TRIAL_THRESHOLDS = (0.35, 0.5, 0.65, 0.8, 1.5)

TRIALS = f"""{PREDS}, settings AS (
  SELECT unnest([{', '.join(f'CAST({t} AS DOUBLE)' for t in TRIAL_THRESHOLDS)}]) AS threshold),
quadrants AS (
  SELECT model, threshold,
         count(*) FILTER (WHERE true_label = 1 AND probability >= threshold) AS tp,
         count(*) FILTER (WHERE true_label = 0 AND probability >= threshold) AS fp,
         count(*) FILTER (WHERE true_label = 1 AND probability < threshold) AS fn
  FROM preds, settings GROUP BY model, threshold),
trials AS (
  SELECT model || '@' || CAST(CAST(round(threshold * 100) AS INTEGER) AS VARCHAR) AS trial, model, threshold,
         CASE WHEN tp + fp = 0 THEN CAST('NaN' AS DOUBLE)
              ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1
  FROM quadrants)"""


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """F1 of each model at each threshold; a threshold nothing reaches is a failed trial."""
    thresholds = F.explode(F.array(*[F.lit(t) for t in TRIAL_THRESHOLDS])).alias("threshold")
    hit, positive = F.col("probability") >= F.col("threshold"), F.col("true_label") == 1
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    f1 = (2 * tp).cast("double") / (2 * tp + fp + fn).cast("double")
    return (
        preds(spark, sf)
        .select("model", "true_label", "probability", thresholds)
        .groupBy("model", "threshold")
        .agg(
            F.count_if(positive & hit).alias("tp"),
            F.count_if(~positive & hit).alias("fp"),
            F.count_if(positive & ~hit).alias("fn"),
        )
        .select(
            F.concat("model", F.lit("@"), F.round(F.col("threshold") * 100).cast("int").cast("string")).alias("trial"),
            "model",
            "threshold",
            F.when(tp + fp == 0, F.lit(float("nan"))).otherwise(f1).alias("f1"),
        )
    )


# --- external set ---------------------------------------------------------------------------

EXTERNAL = """external AS (
  SELECT item_id AS row_id, text AS content,
         CASE WHEN item_id % 2 = 0 THEN 'coded' ELSE 'plain' END AS label FROM benchmark)"""


def external(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(
        F.col("item_id").alias("row_id"),
        F.col("text").alias("content"),
        F.when(F.col("item_id") % 2 == 0, "coded").otherwise("plain").alias("label"),
    )
