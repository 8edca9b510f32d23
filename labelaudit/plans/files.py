"""Readers and writers as queries: what was written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.functions.expressions import text_key
from labelaudit.operators import classifier as L, features as X, ledger as G, review as W
from labelaudit.plans import views as V
from labelaudit.plans.registry import query, r6
from labelaudit.plans.vectors import _WORDS, _docs, _vocab_sql
from labelaudit.session import scratch_path, store
from labelaudit.sources.schemas import LOG_ENTRY, PREDICTIONS, REVIEWED, require_columns
from labelaudit.sources.split_csv import read_csv_parallel
from labelaudit.sources.tables import read_csv, read_training_log, write_table


@query(
    "csv_round_trip",
    V.DECIDED,
    """SELECT md5('"' || d.text || '", ' || chr(10) || p.model) AS text_md5, true_label, predicted_label, round(probability, 9) AS probability
       FROM decided p JOIN documents d ON d.doc_id = p.row_id""",
)
def csv_round_trip(spark, sf):
    """Predictions with quotes, commas and line breaks in the text, written as CSV and read back."""
    back = read_csv(spark, _written(spark, sf), PREDICTIONS)
    return back.select(F.md5("text").alias("text_md5"), "true_label", "predicted_label", "probability")


def _written(spark, sf) -> str:
    from labelaudit.operators.metrics import with_decision

    texts = _docs(spark, sf)
    rows = with_decision(V.preds(spark, sf)).join(texts, "row_id")
    text = F.concat(F.lit('"'), "content", F.lit('", \n'), "model")
    out = rows.select(text.alias("text"), "true_label", "predicted_label", F.round("probability", 9).alias("probability"))
    path = scratch_path(spark, "predictions")
    write_table(require_columns(out, PREDICTIONS.fieldNames()), path, "csv")
    return path


@query(
    "csv_in_ranges",
    V.DECIDED,
    """SELECT md5('"' || d.text || '", ' || chr(10) || p.model) AS text_md5, true_label, predicted_label, round(probability, 9) AS probability
       FROM decided p JOIN documents d ON d.doc_id = p.row_id""",
)
def csv_in_ranges(spark, sf):
    """The same file read by byte ranges, line breaks inside fields and all."""
    back = read_csv_parallel(spark, _written(spark, sf), PREDICTIONS)
    return back.select(F.md5("text").alias("text_md5"), "true_label", "predicted_label", "probability")


@query(
    "ledger_from_nothing",
    V.REVIEWED,
    """SELECT sha256(text) AS text_key, final_label, count(*) AS n FROM reviewed GROUP BY text, final_label""",
)
def ledger_from_nothing(spark, sf):
    """A ledger that does not exist yet is empty; two deliveries are appended to it."""
    path = scratch_path(spark, "ledger")
    before = W.read_ledger(spark, path)
    rows = V.reviewed(spark, sf)
    columns = REVIEWED.fieldNames()
    first = F.col("doc_id") % 4 == 0
    for part in (rows.where(first), rows.where(~first)):
        W.append_decisions(before.unionByName(part.select(*columns)), path)
    now = W.read_ledger(spark, path)
    return now.groupBy(text_key("text").alias("text_key"), "final_label").agg(F.count("*").alias("n"))


@query(
    "ledger_compacted",
    V.REVIEWED,
    """SELECT sha256(text) AS text_key, final_label FROM (
         SELECT *, row_number() OVER (PARTITION BY text ORDER BY review_date DESC, final_label DESC) AS place FROM reviewed WHERE text IS NOT NULL)
       WHERE place = 1""",
)
def ledger_compacted(spark, sf):
    """The latest decision per text, from a snapshot of three deliveries and a fourth after it."""
    ledger, root = scratch_path(spark, "ledger"), scratch_path(spark, "compacted")
    rows = V.reviewed(spark, sf)
    for part in range(4):
        W.append_decisions(rows.where(F.col("doc_id") % 4 == part).select(*REVIEWED.fieldNames()), ledger)
        if part == 2:
            G.compact(spark, ledger, root)
    return G.newest_decisions(spark, ledger, root).select(text_key("text").alias("text_key"), "final_label")


@query(
    "training_log_round_trip",
    V.LOG,
    """SELECT run, step, round(eval_runtime, 6) AS eval_runtime, CAST(eval_samples_per_second AS BIGINT) AS n FROM log""",
)
def training_log_round_trip(spark, sf):
    """One JSON document per run, a log entry per day, read back as rows."""
    log = V.log(spark, sf)
    known = set(log.columns)
    entry = F.struct(
        *[(F.col(f.name) if f.name in known and f.name != "eval_f1" else F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_ENTRY]
    )
    runs = log.groupBy("run").agg(
        F.max("eval_runtime").alias("best_metric"), F.first("run").alias("best_model_checkpoint"), F.collect_list(entry).alias("log_history")
    )  # an entry per day
    path = scratch_path(spark, "logs")
    runs.repartition("run").write.partitionBy("run").json(path)
    back = read_training_log(spark, path)
    return back.select(
        F.col("best_model_checkpoint").alias("run"), "step", r6("eval_runtime"), F.col("eval_samples_per_second").cast("bigint").alias("n")
    )


@query(
    "score_foreign",
    "SELECT doc_id AS row_id, round(length(text) % 100 / CAST(100 AS DOUBLE), 3) AS probability FROM documents",
)
def score_foreign(spark, sf):
    """A model from elsewhere, loaded once per worker: here, one of the text's length."""

    def make_predict():
        import numpy as np

        def predict(texts):
            p = np.array([len(t) % 100 / 100 for t in texts], dtype="float32")
            return np.column_stack([1 - p, p])

        return predict

    out = L.score_foreign(_docs(spark, sf), make_predict, "content", batch_size=256)
    return out.select("row_id", F.round("probability", 3).alias("probability"))


@query(
    "tf_idf",
    _WORDS,
    _vocab_sql(1000),
    """toks AS (SELECT row_id, unnest(toks) AS token FROM words),
tf AS (SELECT row_id, token, count(*) AS n FROM toks WHERE token IN (SELECT token FROM vocab) GROUP BY row_id, token),
idf AS (SELECT token, ln(((SELECT count(*) FROM words) + 1) / CAST(count(*) + 1 AS DOUBLE)) AS w FROM tf GROUP BY token)""",
    "SELECT row_id, tf.token, round(n * w, 6) AS weight FROM tf JOIN idf ON tf.token = idf.token",
)
def tf_idf(spark, sf):
    docs = _docs(spark, sf)
    vocab = store(X.build_vocab(docs, "content", 1000), "vocabulary")
    return X.tf_idf(docs, "content", vocab).select("row_id", "token", r6("weight"))
