"""Confident learning, splits, the review queue and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.functions.expressions import text_key
from labelaudit.operators import confident as C, review as W, split as S
from labelaudit.operators.assemble import exclude
from labelaudit.plans import views as V
from labelaudit.plans.registry import query, r6
from labelaudit.sources.schemas import RAW_DECISIONS
from labelaudit.streaming import decisions as D

# --- splits -------------------------------------------------------------------------------

_SHUFFLED = f"""{V.BASE}, shuffled AS (
  SELECT doc_id AS row_id, quality AS label, md5('42:' || CAST(doc_id AS VARCHAR)) AS h FROM base)"""


def _labelled(spark, sf):
    return V.base(spark, sf).select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))


_STRATIFIED = """strat AS (
  SELECT row_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY h)
         <= round(count(*) OVER (PARTITION BY label) * CAST({frac} AS DOUBLE)) THEN 'val' ELSE 'train' END AS split
  FROM shuffled)"""


@query("stratified_split", _SHUFFLED, _STRATIFIED.format(frac=0.1), "SELECT row_id, label, split FROM strat")
def stratified_split(spark, sf):
    return S.stratified_split(_labelled(spark, sf))


@query(
    "random_split",
    _SHUFFLED,
    """SELECT row_id, CASE WHEN row_number() OVER (ORDER BY h) <= round(count(*) OVER () * CAST(0.1 AS DOUBLE))
              THEN 'val' ELSE 'train' END AS split FROM shuffled""",
)
def random_split(spark, sf):
    return S.random_split(_labelled(spark, sf))


@query(
    "stratified_subset",
    _SHUFFLED,
    _STRATIFIED.format(frac=0.3),
    "SELECT row_id, label FROM strat WHERE split = 'val'",
)
def stratified_subset(spark, sf):
    return S.stratified_subset(_labelled(spark, sf), 0.3)


@query(
    "fold_assignment",
    _SHUFFLED,
    "SELECT row_id, CAST((row_number() OVER (ORDER BY h) - 1) % 5 AS INTEGER) AS fold FROM shuffled",
)
def fold_assignment(spark, sf):
    return S.fold_assignment(_labelled(spark, sf))


@query(
    "split_report",
    _SHUFFLED,
    _STRATIFIED.format(frac=0.1),
    """cells AS (SELECT split, label, count(*) AS n FROM strat GROUP BY split, label
                UNION ALL SELECT 'full', label, count(*) FROM strat GROUP BY label)""",
    """SELECT split, label, n, CAST(sum(n) OVER (PARTITION BY split) AS BIGINT) AS n_split,
              round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY split), 6) AS share FROM cells""",
)
def split_report(spark, sf):
    out = S.split_report(S.stratified_split(_labelled(spark, sf)))
    return out.select("split", "label", "n", "n_split", r6("share"))


# --- confident learning -----------------------------------------------------------------------

_JOINT = """bars AS (SELECT avg(p0) FILTER (WHERE label = 0) AS t0, avg(p1) FILTER (WHERE label = 1) AS t1 FROM scores),
marked AS (
  SELECT label AS given, CASE WHEN p0 >= t0 AND p1 >= t1 THEN (CASE WHEN p1 > p0 THEN 1 ELSE 0 END)
                              WHEN p0 >= t0 THEN 0 WHEN p1 >= t1 THEN 1 END AS "true" FROM scores, bars),
joint AS (
  SELECT g.v AS given, t.v AS "true",
         (SELECT count(*) FROM marked m WHERE m.given = g.v AND m."true" = t.v) AS n
  FROM (SELECT unnest([0, 1]) AS v) g, (SELECT unnest([0, 1]) AS v) t)"""

_RATES = """cells AS (
  SELECT j.given, j."true", j.n, CASE WHEN sum(j.n) OVER (PARTITION BY j.given) > 0
           THEN CAST(j.n * c.n AS DOUBLE) / CAST(sum(j.n) OVER (PARTITION BY j.given) AS DOUBLE)
           WHEN j.given = j."true" THEN CAST(c.n AS DOUBLE) ELSE 0 END AS cell
  FROM joint j JOIN (SELECT label, count(*) AS n FROM scores GROUP BY label) c ON j.given = c.label)"""

_FLAGGED = """flagged AS (
  SELECT row_id, given_label, suggested_label, label_score FROM (
    SELECT row_id, label AS given_label, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS suggested_label,
           CASE WHEN label = 1 THEN p1 ELSE p0 END AS label_score,
           row_number() OVER (PARTITION BY label ORDER BY CASE WHEN label = 1 THEN p0 - p1 ELSE p1 - p0 END DESC, row_id) AS rn
    FROM scores) s JOIN cells c ON c.given = s.given_label AND c."true" = 1 - s.given_label
  WHERE rn <= round(c.cell) AND suggested_label <> given_label)"""


@query(
    "cl_thresholds",
    V.SCORES,
    """SELECT label, round(avg(CASE WHEN label = 1 THEN p1 ELSE p0 END), 6) AS threshold, count(*) AS n
       FROM scores GROUP BY label""",
)
def cl_thresholds(spark, sf):
    return C.class_thresholds(V.scores(spark, sf)).select("label", r6("threshold"), "n")


@query("cl_joint", V.SCORES, _JOINT, 'SELECT given, "true", n FROM joint')
def cl_joint(spark, sf):
    return C.confident_joint(V.scores(spark, sf))


@query(
    "cl_noise_rates",
    V.SCORES,
    _JOINT,
    _RATES,
    """SELECT given, "true", n, CAST(round(cell) AS BIGINT) AS n_cell, round(cell / sum(cell) OVER (), 6) AS q,
              round(cell / sum(cell) OVER (PARTITION BY "true"), 6) AS p_given_if_true,
              round(cell / sum(cell) OVER (PARTITION BY given), 6) AS p_true_if_given FROM cells""",
)
def cl_noise_rates(spark, sf):
    out = C.noise_rates(V.scores(spark, sf))
    rates = ("q", "p_given_if_true", "p_true_if_given")
    return out.select("given", "true", "n", "n_cell", *[r6(c) for c in rates])


@query(
    "cl_label_issues",
    V.SCORES,
    _JOINT,
    _RATES,
    _FLAGGED,
    """SELECT row_id, label AS given_label, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS suggested_label,
              round(CASE WHEN label = 1 THEN p1 ELSE p0 END, 6) AS label_score,
              row_id IN (SELECT row_id FROM flagged) AS is_label_issue FROM scores""",
)
def cl_label_issues(spark, sf):
    out = C.label_issues(V.scores(spark, sf))
    return out.select("row_id", "given_label", "suggested_label", r6("label_score"), "is_label_issue")


@query(
    "cl_suspects",
    V.SCORES,
    _JOINT,
    _RATES,
    _FLAGGED,
    "SELECT row_id, given_label, suggested_label, round(label_score, 6) AS label_score FROM flagged",
)
def cl_suspects(spark, sf):
    out = C.rank_suspects(C.suspects(V.scores(spark, sf)))
    return out.select("row_id", "given_label", "suggested_label", r6("label_score"))


@query(
    "rank_suspects",
    V.BASE,
    V.SUSPECTS,
    """SELECT doc_id AS row_id, label_score_6 AS label_score, place FROM (
         SELECT doc_id, round(label_score, 6) AS label_score_6,
                row_number() OVER (ORDER BY label_score DESC, doc_id) AS place FROM suspects)""",
)
def rank_suspects(spark, sf):
    """Mildest first, with the place written out since a table has no order."""
    from labelaudit.operators.ordering import ranked

    found = V.suspects(spark, sf).select(F.col("doc_id").alias("row_id"), "label_score")
    placed = ranked(found, [], [F.desc("label_score"), F.asc("row_id")], name="place")
    return placed.select("row_id", r6("label_score"), "place")


@query(
    "group_performance",
    V.SCORES,
    """own AS (SELECT term, CASE WHEN label = 1 THEN p1 ELSE p0 END AS s FROM scores)""",
    """SELECT term, count(*) AS n, round(avg(s), 6) AS mean_score,
              round(avg(s) / (SELECT avg(s) FROM own), 6) AS relative FROM own GROUP BY term""",
)
def group_performance(spark, sf):
    out = C.group_performance(V.scores(spark, sf), "term")
    return out.select("term", "n", r6("mean_score"), r6("relative"))


# --- review queue -------------------------------------------------------------------------------


@query(
    "review_exclusions",
    V.REVIEWED,
    """SELECT doc_id, category, final_label FROM reviewed
       WHERE NOT COALESCE(regexp_matches(reviewer_notes, '(?i)remove'), FALSE)
         AND NOT COALESCE(regexp_matches(reviewer_notes, '(?i)unsure|usure'), FALSE)""",
)
def review_exclusions(spark, sf):
    return W.usable(V.reviewed(spark, sf)).select("doc_id", "category", "final_label")


@query(
    "review_changed",
    V.REVIEWED,
    "SELECT doc_id, given_label, final_label, (given_label IS DISTINCT FROM final_label) AS updated FROM reviewed",
)
def review_changed(spark, sf):
    return W.with_changed(V.reviewed(spark, sf)).select("doc_id", "given_label", "final_label", "updated")


@query(
    "review_pending",
    V.REVIEWED,
    V.SUSPECTS,
    """SELECT doc_id, given_label, suggested_label, round(label_score, 6) AS label_score FROM suspects
       WHERE text NOT IN (SELECT text FROM reviewed WHERE text IS NOT NULL)""",
)
def review_pending(spark, sf):
    out = W.pending(V.suspects(spark, sf), V.reviewed(spark, sf), row_id="doc_id")
    return out.select("doc_id", "given_label", "suggested_label", r6("label_score"))


@query(
    "review_next_batch",
    V.REVIEWED,
    V.SUSPECTS,
    """SELECT doc_id, given_label, suggested_label, round(label_score, 6) AS label_score FROM suspects
       WHERE text NOT IN (SELECT text FROM reviewed WHERE text IS NOT NULL)
       ORDER BY suspects.label_score DESC, doc_id LIMIT 10""",
)
def review_next_batch(spark, sf):
    order = [F.desc("label_score"), F.asc("doc_id")]
    out = W.next_batch(V.suspects(spark, sf), V.reviewed(spark, sf), order, 10, "doc_id")
    return out.select("doc_id", "given_label", "suggested_label", r6("label_score"))


_VALID = f"""{V.RAW_DECISIONS}, checked AS (
  SELECT *, lower(trim(answer)) AS a, TRY_CAST(trim(new_label) AS INTEGER) AS l FROM raw),
valid AS (
  SELECT *, CASE WHEN a = 'y' THEN l ELSE given_label END AS final_label FROM checked
  WHERE a = 'n' OR (a = 'y' AND l IN (0, 1)))"""


@query(
    "review_decisions",
    _VALID,
    """SELECT sha256(text) AS text_key, given_label, final_label, review_date, trim(reviewer_notes) AS reviewer_notes FROM valid""",
)
def review_decisions(spark, sf):
    good, _ = W.conform_decisions(V.raw_decisions(spark, sf))
    return good.select(text_key("text").alias("text_key"), "given_label", "final_label", "review_date", "reviewer_notes")


@query(
    "review_rejects",
    _VALID,
    """SELECT doc_id, CASE WHEN a NOT IN ('y', 'n') THEN 'answer is not y or n' ELSE 'new label is not 0 or 1' END AS reason
       FROM checked WHERE doc_id NOT IN (SELECT doc_id FROM valid)""",
)
def review_rejects(spark, sf):
    _, bad = W.conform_decisions(V.raw_decisions(spark, sf))
    return bad.select("doc_id", "reason")


_LATEST = """latest AS (
  SELECT text, final_label, review_date FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY review_date DESC, final_label DESC) AS rn FROM {table})
  WHERE rn = 1)"""


@query(
    "review_latest",
    V.REVIEWED,
    _LATEST.format(table="reviewed"),
    "SELECT sha256(text) AS text_key, final_label, review_date FROM latest",
)
def review_latest(spark, sf):
    return W.latest_decisions(V.reviewed(spark, sf))


@query(
    "review_stream",
    _VALID,
    _LATEST.format(table="valid"),
    "SELECT sha256(text) AS text_key, final_label, review_date FROM latest",
)
def review_stream(spark, sf):
    """Decision files through the stream into a ledger; its latest decisions."""
    from labelaudit.session import scratch_path

    home = scratch_path(spark, "decisions")
    V.raw_decisions(spark, sf).select(*RAW_DECISIONS.fieldNames()).write.parquet(f"{home}/inbox")
    D.stream_decisions(
        spark, f"{home}/inbox", f"{home}/ledger", f"{home}/rejects", f"{home}/progress"
    ).awaitTermination()
    return W.latest_decisions(D.read_streamed_ledger(spark, f"{home}/ledger"))


@query(
    "review_stats",
    V.REVIEWED,
    V.SUSPECTS,
    """SELECT count(*) AS n_reviewed, count(*) FILTER (WHERE given_label IS DISTINCT FROM final_label) AS n_changed,
              round(count(*) FILTER (WHERE given_label IS DISTINCT FROM final_label) * CAST(100 AS DOUBLE) / count(*), 6) AS pct_changed,
              (SELECT count(*) FROM suspects WHERE text NOT IN (SELECT text FROM reviewed WHERE text IS NOT NULL)) AS n_remaining
       FROM reviewed""",
)
def review_stats(spark, sf):
    out = W.review_stats(V.suspects(spark, sf), V.reviewed(spark, sf), "doc_id")
    return out.select("n_reviewed", "n_changed", r6("pct_changed"), "n_remaining")


# --- corrections ----------------------------------------------------------------------------------


@query(
    "apply_corrections",
    V.CORPUS,
    V.REVIEWED,
    _LATEST.format(table="reviewed"),
    """SELECT c.row_id, c.term, COALESCE(l.final_label, c.label) AS label FROM corpus c LEFT JOIN latest l ON c.content = l.text""",
)
def apply_corrections(spark, sf):
    return W.apply_corrections(V.corpus(spark, sf), V.reviewed(spark, sf)).select("row_id", "term", "label")


@query(
    "exclude_unreviewed",
    V.CORPUS,
    V.REVIEWED,
    V.SUSPECTS,
    """SELECT row_id, term, label FROM corpus WHERE content IS NULL OR content NOT IN (
         SELECT text FROM suspects WHERE text NOT IN (SELECT text FROM reviewed WHERE text IS NOT NULL))""",
)
def exclude_unreviewed(spark, sf):
    open_cases = W.pending(V.suspects(spark, sf), V.reviewed(spark, sf), row_id="doc_id")
    return exclude(V.corpus(spark, sf), open_cases, "content", "text", "row_id").select("row_id", "term", "label")
