"""Sources, cleaning, expressions and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.functions import expressions as E
from labelaudit.operators import assemble as A
from labelaudit.plans import views as V
from labelaudit.plans.registry import query, r6
from labelaudit.sources.schemas import conform, conform_losses, fields, normalize_columns
from labelaudit.sources.tables import read_table


@query("scan_split", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr'")
def scan_split(spark, sf):
    """The filter on the split column and the three columns reach the scan."""
    from labelaudit.sources.tables import read_split

    return read_split(spark, f"{sf}/documents.parquet", "fr", column="lang").select(
        "doc_id", "source", "n_chars"
    )


_TYPED = """typed AS (
  SELECT doc_id AS row_id,
         CASE WHEN doc_id % 10 = 0 THEN 'n/a' WHEN doc_id % 10 = 1 THEN CAST(quality AS VARCHAR) || '.0'
              ELSE CAST(quality AS VARCHAR) END AS label,
         CASE WHEN doc_id % 12 = 0 THEN 'none' ELSE CAST(toxic AS VARCHAR) || '.25' END AS score
  FROM labels)"""
_TYPED_SCHEMA = fields(row_id="bigint", label="int", score="double")


def _typed(spark, sf):
    doc, quality = F.col("doc_id"), F.col("quality").cast("string")
    return read_table(spark, sf, "labels").select(
        doc.alias("row_id"),
        F.when(doc % 10 == 0, "n/a").when(doc % 10 == 1, F.concat(quality, F.lit(".0"))).otherwise(quality).alias("label"),
        F.when(doc % 12 == 0, "none").otherwise(F.concat(F.col("toxic").cast("string"), F.lit(".25"))).alias("score"),
    )


@query(
    "conform_casts",
    _TYPED,
    "SELECT row_id, CAST(TRY_CAST(label AS DOUBLE) AS INTEGER) AS label, TRY_CAST(score AS DOUBLE) AS score FROM typed",
)
def conform_casts(spark, sf):
    return conform(_typed(spark, sf), _TYPED_SCHEMA)


@query(
    "conform_losses",
    _TYPED,
    """SELECT 'row_id' AS column_name, count(row_id) AS n_present, CAST(0 AS BIGINT) AS n_lost FROM typed
       UNION ALL SELECT 'label', count(label), count(*) FILTER (WHERE label IS NOT NULL AND TRY_CAST(label AS DOUBLE) IS NULL) FROM typed
       UNION ALL SELECT 'score', count(score), count(*) FILTER (WHERE score IS NOT NULL AND TRY_CAST(score AS DOUBLE) IS NULL) FROM typed""",
)
def conform_losses_(spark, sf):
    return conform_losses(_typed(spark, sf), _TYPED_SCHEMA)


@query("filter_by_value", V.CORPUS, "SELECT row_id, term, n_chars FROM corpus WHERE ingroup = 'en'")
def filter_by_value(spark, sf):
    """Split on a stored column, so that the scan reads only what it must."""
    return A.by_value(V.corpus(spark, sf), "ingroup", "en").select("row_id", "term", "n_chars")


@query(
    "drop_missing",
    V.CORPUS,
    "SELECT row_id, label, n_chars FROM corpus WHERE content IS NOT NULL AND label IS NOT NULL",
)
def drop_missing(spark, sf):
    return A.drop_missing(V.corpus(spark, sf), ["content"], ["label", "lable"]).select(
        "row_id", "label", "n_chars"
    )


@query("default_label", V.CORPUS, "SELECT row_id, COALESCE(label, 1) AS label FROM corpus")
def default_label(spark, sf):
    return V.corpus(spark, sf).select("row_id", E.default_label("label").alias("label"))


@query(
    "binarize_label",
    V.EXTERNAL,
    "SELECT row_id, CASE WHEN label = 'coded' THEN 1 ELSE 0 END AS label, length(content) AS n FROM external",
)
def binarize_label(spark, sf):
    """The external set as scoring takes it: renamed text column, integer label."""
    raw = V.external(spark, sf).withColumnRenamed("content", "example")
    return normalize_columns(raw).select(
        "row_id", E.binarize("label", "coded").alias("label"), F.length("content").cast("bigint").alias("n")
    )


@query(
    "ellipsize",
    "SELECT doc_id AS row_id, CASE WHEN length(text) > 20 THEN substring(text, 1, 20) || '...' ELSE text END AS shown FROM documents",
)
def ellipsize(spark, sf):
    return read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), E.ellipsize("text", 20).alias("shown")
    )


@query(
    "canonical_terms",
    V.CORPUS,
    """SELECT row_id, regexp_replace(CASE WHEN term = 'src3' THEN 'third source' ELSE term END,
              '^src1.*', 'teens') AS term FROM corpus""",
)
def canonical_terms(spark, sf):
    named = E.replace_values("term", {"src3": "third source"})
    return V.corpus(spark, sf).select("row_id", E.replace_pattern(named, "^src1.*", "teens").alias("term"))


_INSTRUCTION = "Decide whether the next text is coded. Answer 0 or 1. Text: "


@query(
    "format_prompt",
    V.CORPUS,
    f"""SELECT row_id, CAST(length('{_INSTRUCTION}' || content) AS BIGINT) AS n_prompt,
               md5('{_INSTRUCTION}' || content) AS prompt_md5 FROM corpus""",
)
def format_prompt(spark, sf):
    prompts = V.corpus(spark, sf).withColumn("prompt", E.prompt(_INSTRUCTION, "content"))
    return prompts.select(
        "row_id", F.length("prompt").cast("bigint").alias("n_prompt"), F.md5("prompt").alias("prompt_md5")
    )


@query(
    "threshold_decision",
    V.PREDS,
    "SELECT model, row_id, CASE WHEN probability >= 0.5 THEN 1 ELSE 0 END AS predicted_label FROM preds",
)
def threshold_decision(spark, sf):
    return V.preds(spark, sf).select("model", "row_id", E.decide("probability").alias("predicted_label"))


_LOGITS = "ln((probability + 0.01) / (1.01 - probability))"


@query(
    "softmax_prob",
    V.PREDS,
    f"""SELECT model, row_id, round(exp(z - m) / (exp(0.5 - m) + exp(z - m)), 6) AS p1
        FROM (SELECT *, greatest(z, 0.5) AS m FROM (SELECT *, {_LOGITS} AS z FROM preds))""",
)
def softmax_prob(spark, sf):
    p = F.col("probability")
    logits = F.array(F.lit(0.5), F.log((p + 0.01) / (1.01 - p)))
    return V.preds(spark, sf).select("model", "row_id", r6(F.get(E.softmax(logits), F.lit(1)), "p1"))


@query(
    "argmax_class",
    V.PREDS,
    """SELECT model, row_id, CASE
         WHEN row_id % 5 = 0 THEN (CASE WHEN 0.5 - probability > 0 THEN 1 ELSE 0 END)
         WHEN row_id % 5 = 1 THEN 0
         WHEN 0.5 - probability > probability - 0.5 THEN 1 ELSE 0 END AS predicted_label FROM preds""",
)
def argmax_class(spark, sf):
    p, kind = F.col("probability"), F.col("row_id") % 5
    first = F.when(kind == 0, F.lit(float("nan"))).otherwise(p - 0.5)
    second = F.when(kind == 1, p - 0.5).otherwise(0.5 - p)  # a tie where kind is 1
    return V.preds(spark, sf).select("model", "row_id", E.argmax_class(F.array(first, second)).alias("predicted_label"))


@query(
    "parse_dates",
    V.DATED,
    """SELECT row_id, CAST(COALESCE(TRY_STRPTIME(date_text, '%m/%d/%Y'), TRY_STRPTIME(date_text, '%Y-%m-%d')) AS DATE) AS parsed
       FROM dated""",
)
def parse_dates(spark, sf):
    return V.dated(spark, sf).select(
        "row_id", E.parse_dates("date_text", ["MM/dd/yyyy", "yyyy-MM-dd"]).alias("parsed")
    )


# --- deduplication -----------------------------------------------------------------------


@query(
    "dedupe_keep_first",
    V.CORPUS,
    """SELECT row_id, term, label FROM (
         SELECT *, row_number() OVER (PARTITION BY content ORDER BY row_id) AS rn FROM corpus WHERE content IS NOT NULL)
       WHERE rn = 1""",
)
def dedupe_keep_first(spark, sf):
    return A.dedupe(V.corpus(spark, sf), ["content"], "row_id").select("row_id", "term", "label")


@query(
    "duplicate_members",
    V.CORPUS,
    """SELECT row_id, term, label FROM (
         SELECT *, count(*) OVER (PARTITION BY content) AS n FROM corpus WHERE content IS NOT NULL) WHERE n > 1""",
)
def duplicate_members(spark, sf):
    return A.duplicate_members(V.corpus(spark, sf), ["content"]).select("row_id", "term", "label")


@query(
    "dedupe_report",
    V.CORPUS,
    """SELECT type, count(*) AS n_before, count(DISTINCT content) AS n_after,
              count(*) - count(DISTINCT content) AS n_removed FROM corpus WHERE content IS NOT NULL GROUP BY type""",
)
def dedupe_report(spark, sf):
    return A.dedupe_report(V.corpus(spark, sf), ["content"], ["type"])


def _turns(spark, sf):
    return read_table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        F.col("text").alias("content"),
        F.col("role").alias("ingroup"),
        F.lit(0).alias("label"),
    )


_STACKED = f"""{V.CORPUS}, stacked AS (
  SELECT 0 AS source_no, row_id, content, term, ingroup, COALESCE(label, 1) AS label FROM corpus
  UNION ALL
  SELECT 1, conv_id * 1000 + turn, text, NULL, role, 0 FROM conversations)"""


@query("assemble_corpora", _STACKED,
       "SELECT source_no, row_id, term, ingroup, label FROM stacked")
def assemble_corpora(spark, sf):
    """Two sources with different columns; copies are kept."""
    first = V.corpus(spark, sf).select("row_id", "content", "term", "ingroup", E.default_label("label").alias("label"))
    stacked = A.assemble(first.withColumn("source_no", F.lit(0)), _turns(spark, sf).withColumn("source_no", F.lit(1)))
    return stacked.select("source_no", "row_id", "term", "ingroup", "label")


@query(
    "assemble_and_dedupe",
    _STACKED,
    """SELECT source_no, row_id, term, ingroup, label FROM (
         SELECT *, row_number() OVER (PARTITION BY content ORDER BY source_no, row_id) AS rn
         FROM stacked WHERE content IS NOT NULL) WHERE rn = 1""",
)
def assemble_and_dedupe(spark, sf):
    """Copies across sources are removed too; the first source wins."""
    first = V.corpus(spark, sf).select("row_id", "content", "term", "ingroup", "label")
    return A.assemble_and_dedupe([first, _turns(spark, sf)]).select(
        "source_no", "row_id", "term", "ingroup", "label"
    )


@query(
    "key_uniqueness",
    "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
)
def key_uniqueness(spark, sf):
    return A.repeated_keys(read_table(spark, sf, "conversations"), ["conv_id"])
