"""Counts, summaries, top-k lists and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelaudit.functions.expressions import parse_dates
from labelaudit.operators import profile as P, sketches as S, trend as R
from labelaudit.plans import views as V
from labelaudit.plans.registry import query, r6
from labelaudit.session import store
from labelaudit.sources.tables import read_table


@query("value_counts", V.CORPUS, "SELECT term, count(*) AS n FROM corpus WHERE term IS NOT NULL GROUP BY term")
def value_counts(spark, sf):
    return P.value_counts(V.corpus(spark, sf), "term")


@query(
    "label_shares",
    V.CORPUS,
    """SELECT label, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(label) FROM corpus), 6) AS share
       FROM corpus WHERE label IS NOT NULL GROUP BY label""",
)
def label_shares(spark, sf):
    return P.value_shares(V.corpus(spark, sf), "label").select("label", "n", r6("share"))


@query(
    "group_shares",
    V.CORPUS,
    """SELECT type, label, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY type), 6) AS share
       FROM corpus WHERE label IS NOT NULL GROUP BY type, label""",
)
def group_shares(spark, sf):
    return P.group_shares(V.corpus(spark, sf), "type", "label").select("type", "label", "n", r6("share"))


@query(
    "distinct_profile",
    V.CORPUS,
    """SELECT 'term' AS column_name, count(DISTINCT term) AS n_distinct FROM corpus
       UNION ALL SELECT 'ingroup', count(DISTINCT ingroup) FROM corpus
       UNION ALL SELECT 'label', count(DISTINCT label) FROM corpus""",
)
def distinct_profile(spark, sf):
    return P.distinct_profile(V.corpus(spark, sf), ["term", "ingroup", "label"])


@query(
    "corpus_extent",
    V.DATED,
    """SELECT count(*) AS n_rows, min(d) AS first_date, max(d) AS last_date FROM (
         SELECT CAST(COALESCE(TRY_STRPTIME(date_text, '%m/%d/%Y'), TRY_STRPTIME(date_text, '%Y-%m-%d')) AS DATE) AS d FROM dated)""",
)
def corpus_extent(spark, sf):
    parsed = V.dated(spark, sf).select(parse_dates("date_text", ["MM/dd/yyyy", "yyyy-MM-dd"]).alias("d"))
    return P.extent(parsed, "d")


@query(
    "positive_rate",
    V.CORPUS,
    "SELECT term, round(avg(label), 6) AS positive_rate FROM corpus GROUP BY term",
)
def positive_rate(spark, sf):
    return P.positive_rate(V.corpus(spark, sf), by=["term"]).select("term", r6("positive_rate"))


def _describe_sql(name: str, column: str, table: str) -> str:
    return f"""SELECT '{name}' AS column_name, count({column}) AS n, round(avg({column}), 4) AS mean,
       round(stddev_samp({column}), 4) AS sd, round(CAST(min({column}) AS DOUBLE), 6) AS min,
       round(CAST(max({column}) AS DOUBLE), 6) AS max,
       round(quantile_cont(CAST({column} AS DOUBLE), 0.25), 6) AS q25,
       round(quantile_cont(CAST({column} AS DOUBLE), 0.5), 6) AS q50,
       round(quantile_cont(CAST({column} AS DOUBLE), 0.75), 6) AS q75 FROM {table}"""


@query(
    "describe_numeric",
    _describe_sql("o_totalprice", "o_totalprice", "orders")
    + " UNION ALL "
    + _describe_sql("o_custkey", "o_custkey", "orders"),
)
def describe_numeric(spark, sf):
    out = P.describe(read_table(spark, sf, "orders"), ["o_totalprice", "o_custkey"])
    return out.select(
        "column_name", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"),
        *[r6(c) for c in ("min", "max", "q25", "q50", "q75")],
    )


@query(
    "null_profile",
    V.CORPUS,
    """SELECT 'row_id' AS column_name, 'bigint' AS type, count(*) AS n_rows, count(row_id) AS n_present FROM corpus
       UNION ALL SELECT 'content', 'string', count(*), count(content) FROM corpus
       UNION ALL SELECT 'type', 'string', count(*), count(type) FROM corpus
       UNION ALL SELECT 'term', 'string', count(*), count(term) FROM corpus
       UNION ALL SELECT 'ingroup', 'string', count(*), count(ingroup) FROM corpus
       UNION ALL SELECT 'label', 'int', count(*), count(label) FROM corpus
       UNION ALL SELECT 'n_chars', 'bigint', count(*), count(n_chars) FROM corpus""",
)
def null_profile(spark, sf):
    return P.null_profile(V.corpus(spark, sf))


def _top(column: str, k: int, where: str) -> str:
    return (f"SELECT {column} FROM corpus WHERE {column} IS NOT NULL AND {where} "
            f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT {k}")


_CROSSTAB = f"""pairs AS (
  SELECT term, ingroup, count(*) AS n FROM corpus
  WHERE term IN ({_top('term', 10, 'label = 1')}) AND ingroup IN ({_top('ingroup', 10, 'TRUE')})
  GROUP BY term, ingroup)"""


@query("crosstab_topk", V.CORPUS, _CROSSTAB, "SELECT term, ingroup, n FROM pairs")
def crosstab_topk(spark, sf):
    """Row list from positives, column list and counts from all rows."""
    return P.crosstab_topk(
        V.corpus(spark, sf), "term", "ingroup", 10, 10, row_filter=F.col("label") == 1
    ).select("term", "ingroup", "n")


@query(
    "crosstab_wide",
    V.CORPUS,
    _CROSSTAB,
    """SELECT term, CAST(coalesce(sum(n) FILTER (WHERE ingroup = 'de'), 0) AS BIGINT) AS de,
              CAST(coalesce(sum(n) FILTER (WHERE ingroup = 'en'), 0) AS BIGINT) AS en,
              CAST(coalesce(sum(n) FILTER (WHERE ingroup = 'es'), 0) AS BIGINT) AS es,
              CAST(coalesce(sum(n) FILTER (WHERE ingroup = 'fr'), 0) AS BIGINT) AS fr
       FROM pairs GROUP BY term""",
)
def crosstab_wide(spark, sf):
    """The crosstab above in wide form, a column for every value in its list."""
    return P.widen(crosstab_topk(spark, sf), "term", "ingroup")


@query(
    "topk_by_flag",
    V.REVIEWED,
    """SELECT r.category, t.n_category, (r.given_label IS DISTINCT FROM r.final_label) AS updated, count(*) AS n
       FROM reviewed r JOIN (SELECT category, count(*) AS n_category FROM reviewed GROUP BY category
                             ORDER BY count(*) DESC, category LIMIT 8) t ON r.category = t.category
       GROUP BY 1, 2, 3""",
)
def topk_by_flag(spark, sf):
    from labelaudit.operators.review import with_changed

    return P.topk_by_flag(with_changed(V.reviewed(spark, sf)), "category", "updated", 8)


@query(
    "box_stats",
    V.SCORES,
    """quart AS (SELECT label, quantile_cont(s, 0.25) AS q25, quantile_cont(s, 0.5) AS q50, quantile_cont(s, 0.75) AS q75
                FROM (SELECT label, CASE WHEN label = 1 THEN p1 ELSE p0 END AS s FROM scores) GROUP BY label),
       pts AS (SELECT label, CASE WHEN label = 1 THEN p1 ELSE p0 END AS s FROM scores),
       marked AS (SELECT pts.label, s, q25, q50, q75,
                         s BETWEEN q25 - 0.1 * (q75 - q25) AND q75 + 0.1 * (q75 - q25) AS inside
                  FROM pts JOIN quart ON pts.label = quart.label)""",
    """SELECT label, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
              round(min(s) FILTER (WHERE inside), 6) AS whisker_low, round(max(s) FILTER (WHERE inside), 6) AS whisker_high,
              count(*) FILTER (WHERE NOT inside) AS n_outliers FROM marked GROUP BY label, q25, q50, q75""",
)
def box_stats(spark, sf):
    """Short whiskers (0.1) so that the given scores have outliers."""
    scored = V.scores(spark, sf).select("label", F.get("p", F.col("label")).alias("s"))
    out = P.box_stats(scored, "label", "s", whisker=0.1)
    names = ("q25", "q50", "q75", "whisker_low", "whisker_high")
    return out.select("label", *[r6(c) for c in names], "n_outliers")


@query(
    "class_weights",
    V.BASE,
    """SELECT quality AS label, count(*) AS n,
              round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight
       FROM base GROUP BY quality""",
)
def class_weights(spark, sf):
    labelled = V.base(spark, sf).select(F.col("quality").alias("label"))
    return P.class_weights(labelled).select("label", "n", r6("weight"))


@query(
    "category_overlap",
    V.CORPUS,
    """SELECT term, CASE WHEN max(label) = 1 AND min(label) = 0 THEN 'both' WHEN max(label) = 1 THEN 'positive'
              ELSE 'negative' END AS found_in FROM corpus WHERE term IS NOT NULL AND label IN (0, 1) GROUP BY term""",
)
def category_overlap(spark, sf):
    return P.category_overlap(V.corpus(spark, sf), "term")


@query(
    "overlap_counts",
    V.CORPUS,
    """sides AS (SELECT term, max(label) = 1 AS p, min(label) = 0 AS n FROM corpus
                WHERE term IS NOT NULL AND label IN (0, 1) GROUP BY term)""",
    """SELECT count(*) FILTER (WHERE p) AS n_positive, count(*) FILTER (WHERE n) AS n_negative,
              count(*) FILTER (WHERE p AND n) AS n_both, count(*) FILTER (WHERE p AND NOT n) AS n_only_positive,
              count(*) FILTER (WHERE n AND NOT p) AS n_only_negative FROM sides""",
)
def overlap_counts(spark, sf):
    return P.overlap_counts(V.corpus(spark, sf), "term")


@query(
    "top_k_terms",
    V.CORPUS,
    "SELECT term, count(*) AS n FROM corpus WHERE label = 1 AND term IS NOT NULL GROUP BY term ORDER BY count(*) DESC, term LIMIT 10",
)
def top_k_terms(spark, sf):
    return P.top_k(V.corpus(spark, sf).where("label = 1"), "term", 10)


@query(
    "top_k_by_class",
    V.CORPUS,
    """SELECT label, term, n, place FROM (
         SELECT label, term, n, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS INTEGER) AS place
         FROM (SELECT label, term, count(*) AS n FROM corpus WHERE label IS NOT NULL AND term IS NOT NULL GROUP BY label, term))
       WHERE place <= 5""",
)
def top_k_by_class(spark, sf):
    return P.top_k_by(V.corpus(spark, sf), "label", "term", 5).select("label", "term", "n", "place")


# --- trends ---------------------------------------------------------------------------------

_MONTHLY = f"""{V.TREND}, monthly AS (
  SELECT CAST(date_trunc('month', ts) AS DATE) AS month, label, count(*) AS n FROM trend
  WHERE ts IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2)"""


@query("monthly_counts_by_label", _MONTHLY, "SELECT month, label, n FROM monthly")
def monthly_counts_by_label(spark, sf):
    return R.monthly_counts(V.trend(spark, sf), "ts", ["label"])


@query(
    "smoothed_by_label",
    _MONTHLY,
    """SELECT month, label, n, round(avg(n) OVER (PARTITION BY label ORDER BY month
              ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM monthly""",
)
def smoothed_by_label(spark, sf):
    counts = R.monthly_counts(V.trend(spark, sf), "ts", ["label"])
    return R.smooth(counts, ["label"], "month", 6).select("month", "label", "n", r6("smoothed"))


@query(
    "smoothed_total",
    V.TREND,
    """SELECT month, n, round(avg(n) OVER (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS smoothed
       FROM (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS n FROM trend WHERE ts IS NOT NULL GROUP BY 1)""",
)
def smoothed_total(spark, sf):
    counts = R.monthly_counts(V.trend(spark, sf), "ts")
    return R.smooth(counts, [], "month", 6).select("month", "n", r6("smoothed"))


@query(
    "yearly_trend_topk",
    V.TREND,
    """positive AS (SELECT * FROM trend WHERE label = 1),
       counts AS (SELECT category, CAST(year(ts) AS INTEGER) AS year, count(*) AS n FROM positive
                 WHERE category IN (SELECT category FROM positive GROUP BY category ORDER BY count(*) DESC, category LIMIT 10)
                 GROUP BY 1, 2),
       calendar AS (SELECT category, CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM counts GROUP BY category)""",
    """SELECT c.category, c.year, COALESCE(k.n, 0) AS n FROM calendar c
       LEFT JOIN counts k ON c.category = k.category AND c.year = k.year""",
)
def yearly_trend_topk(spark, sf):
    """Positive rows of the ten most frequent categories, by year."""
    return R.yearly_trend(V.trend(spark, sf).where("label = 1"), "category", "ts", 10)


# --- sketches, kept per day and merged by week --------------------------------------------------


def _by_day(spark, sf):
    day = F.to_date("ts")
    return read_table(spark, sf, "events").select(day.alias("day"), "user_id", "value")


def _week():
    return F.floor((F.dayofmonth("day") - 1) / 7).cast("int")


_SKETCHED = """registers AS (
  SELECT CAST(ts AS DATE) AS day, CAST('0x' || substr(md5(user_id::VARCHAR), 1, 3) AS BIGINT) AS register,
         max(CASE WHEN rest = 0 THEN 53 ELSE 53 - length(bin(rest)) END) AS zeros
  FROM (SELECT ts, user_id, CAST('0x' || substr(md5(user_id::VARCHAR), 4, 13) AS BIGINT) AS rest FROM events WHERE user_id IS NOT NULL)
  GROUP BY 1, 2),
weekly AS (SELECT (day(day) - 1) // 7 AS week, register, max(zeros) AS zeros FROM registers GROUP BY 1, 2),
estimates AS (
  SELECT week, (0.7213 / (1 + 1.079 / 4096::DOUBLE)) * 4096 * 4096 / (sum(pow(2.0, -zeros)) + 4096 - count(*)) AS raw, count(*) AS used
  FROM weekly GROUP BY week)"""


@query(
    "weekly_distinct_estimate",
    _SKETCHED,
    """SELECT CAST(week AS INTEGER) AS week, round(CASE WHEN raw <= 10240 AND used < 4096 THEN 4096 * ln(4096::DOUBLE / (4096 - used)) ELSE raw END, 3) AS n
       FROM estimates""",
)
def weekly_distinct_estimate(spark, sf):
    """Users of each week, estimated from the stored sketches of its days."""
    days = store(S.distinct_sketch(_by_day(spark, sf), "user_id", ["day"]), "distinct-sketches")
    found = S.distinct_estimate(days.withColumn("week", _week()), ["week"])
    return found.select("week", F.round("n", 3).alias("n"))


_STEP = "ln(1.01::DOUBLE / 0.99)"


@query(
    "weekly_quantile_estimate",
    f"""buckets AS (
  SELECT (day(ts) - 1) // 7 AS week, sign(value) AS side, CASE WHEN value = 0 THEN 0 ELSE ceil(ln(abs(value)) / {_STEP}) END AS bucket, count(*) AS n
  FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY 1, 2, 3),
upto AS (
  SELECT *, sum(n) OVER (PARTITION BY week ORDER BY side, side * bucket) AS upto, sum(n) OVER (PARTITION BY week) AS total FROM buckets),
probs AS (SELECT unnest([0.05, 0.5, 0.95]) AS prob)""",
    """SELECT CAST(week AS INTEGER) AS week, CAST(prob AS DOUBLE) AS prob,
              round(side * 2 / (1.01::DOUBLE / 0.99 + 1) * pow(1.01::DOUBLE / 0.99, bucket), 6) AS value
       FROM upto, probs WHERE upto >= greatest(ceil(prob * total), 1) AND upto - n < greatest(ceil(prob * total), 1)""",
)
def weekly_quantile_estimate(spark, sf):
    """Quantiles of each week's values, from the stored sketches of its days."""
    days = store(S.quantile_sketch(_by_day(spark, sf), "value", ["day"]), "quantile-sketches")
    found = S.quantile_estimate(days.withColumn("week", _week()), [0.05, 0.5, 0.95], ["week"])
    return found.select("week", "prob", r6("value"))
