"""Tokens, document vectors, nearest neighbours, near copies and the quality report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from labelaudit.operators import confident as C, density as D, features as X, lsh as L, neighbours as N, setjoin as S
from labelaudit.operators.ordering import ranked
from labelaudit.operators.profile import null_profile
from labelaudit.plans import views as V
from labelaudit.plans.registry import query, r6
from labelaudit.plans.reviews import _FLAGGED, _JOINT, _RATES
from labelaudit.session import store
from labelaudit.sources.tables import read_table

# --- tokens -----------------------------------------------------------------------------------

_WORDS = """words AS (
  SELECT doc_id AS row_id, list_filter(string_split_regex(lower(text), '[ \n]+'), lambda t: t <> '') AS toks FROM documents)"""


def _vocab_sql(size: int) -> str:
    return f"""vocab AS (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 1 AS INTEGER) AS token_id, n
  FROM (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM words) GROUP BY token
        ORDER BY n DESC, token LIMIT {size}))"""


def _docs(spark, sf):
    return read_table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("content"))


@query("vocab_top", _WORDS, _vocab_sql(1000), "SELECT token, token_id, n FROM vocab")
def vocab_top(spark, sf):
    return X.build_vocab(_docs(spark, sf), "content", 1000)


@query(
    "encode_fixed_length",
    _WORDS,
    _vocab_sql(1000),
    """parts AS (SELECT row_id, len(toks) AS n_tokens, unnest(range(1, 513)) AS pos, toks FROM words)""",
    """SELECT row_id, string_agg(CAST(CASE WHEN pos > n_tokens THEN 0 ELSE COALESCE(token_id, 1) END AS VARCHAR), ' ' ORDER BY pos) AS ids,
              CAST(count(*) FILTER (WHERE pos <= n_tokens) AS BIGINT) AS n_mask, CAST(n_tokens AS INTEGER) AS n_tokens
       FROM (SELECT p.row_id, p.pos, p.n_tokens, v.token_id FROM parts p LEFT JOIN vocab v ON v.token = p.toks[p.pos])
       GROUP BY row_id, n_tokens""",
)
def encode_fixed_length(spark, sf):
    """Arrays are shown as text, so that any engine can compare them."""
    docs = _docs(spark, sf)
    encoded = X.encode(docs, "content", X.build_vocab(docs, "content", 1000), 512)
    ones = F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return encoded.select("row_id", F.array_join("ids", " ").alias("ids"), ones.alias("n_mask"), "n_tokens")


# --- document vectors ---------------------------------------------------------------------------

_DIM = 64
# A token takes the given vector whose place is the token's hash modulo their number.
_POOLED = """toks AS (SELECT row_id, unnest(toks) AS token FROM words),
places AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, embedding FROM embeddings),
numbers AS (SELECT slot, d, CAST(embedding[d] AS DOUBLE) AS x FROM places, (SELECT unnest(range(1, 65)) AS d)),
hits AS (
  SELECT row_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings) AS slot, count(*) AS n
  FROM toks GROUP BY 1, 2),
dims AS (SELECT row_id, d, sum(n * x) / sum(n) AS x FROM hits JOIN numbers ON hits.slot = numbers.slot GROUP BY row_id, d)"""


def _pooled(spark, sf, docs: DataFrame) -> DataFrame:
    """Mean of the vectors of a text's tokens, for every text of ``docs``."""
    given = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    places = ranked(given.select("vec_id"), [], ["vec_id"], name="place")
    n = places.count()
    vectors = store(given.join(places, "vec_id").select((F.col("place") - 1).alias("token"), "v"), "token-vectors")

    def slot(token):
        return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % n

    return X.mean_pool(docs, "content", vectors, _DIM, key=slot)


def _doc_vectors(spark, sf) -> DataFrame:
    return _pooled(spark, sf, _docs(spark, sf))


@query("mean_pool", _WORDS, _POOLED,
       """SELECT w.row_id, CAST(d - 1 AS INTEGER) AS dim, round(x, 6) AS x FROM words w LEFT JOIN dims ON w.row_id = dims.row_id""")
def mean_pool(spark, sf):
    """Every document; one without tokens has a row without a vector."""
    pooled = _doc_vectors(spark, sf)
    return pooled.select("row_id", F.posexplode_outer("vector").alias("dim", "x")).select("row_id", "dim", r6("x"))


# --- neighbours -----------------------------------------------------------------------------------


def _knn_sql(points: str, k: int = 10) -> str:
    return f"""apart AS MATERIALIZED (
  SELECT a.row_id, b.row_id AS other, greatest(1 - list_cosine_similarity(a.v, b.v), 0) AS distance
  FROM {points} a JOIN {points} b ON a.row_id <> b.row_id),
knn AS (
  SELECT row_id, other, distance, place FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(distance, 9), other) AS place FROM apart) WHERE place <= {k})"""


_GIVEN = """given AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""


def _near_sql(factor: float) -> str:
    """Sets of all rows within the radius, from the table of all distances."""
    return f"""radius AS (SELECT median(distance) * CAST({factor} AS DOUBLE) AS r FROM knn WHERE place = 1),
pairs AS (SELECT row_id, other, distance FROM apart, radius WHERE round(distance, 9) <= r),
near AS (
  SELECT k.row_id, k.distance AS nearest, (p.row_id IS NOT NULL) AS is_near_duplicate,
         COALESCE(p.n, 0) + 1 AS set_size, least(k.row_id, COALESCE(p.first, k.row_id)) AS set_first
  FROM knn k LEFT JOIN (SELECT row_id, count(*) AS n, min(other) AS first FROM pairs GROUP BY row_id) p
  ON k.row_id = p.row_id WHERE k.place = 1)"""


#: Rows that hold the same vector are members of the smallest one, between which the pairs are given.
_MEMBERS = """members AS (SELECT row_id, least(row_id, COALESCE(min(other), row_id)) AS first FROM
  (SELECT row_id, NULL::BIGINT AS other FROM given UNION ALL SELECT row_id, other FROM apart WHERE round(distance, 9) <= 0)
  GROUP BY row_id)"""

# Blocks small enough that the given tables fill several cells and blocks.
_GIVEN_BLOCK, _DOC_BLOCK = 256, 1024


def _given_knn(spark, sf, only: str | None = None) -> DataFrame:
    return N.knn(read_table(spark, sf, "embeddings"), "embedding", 10, "vec_id", _GIVEN_BLOCK, only=only)


@query("knn_cosine", _GIVEN, _knn_sql("given"),
       "SELECT row_id, other, round(distance, 6) AS distance, CAST(place AS INTEGER) AS place FROM knn")
def knn_cosine(spark, sf):
    return _given_knn(spark, sf).select("row_id", "other", r6("distance"), "place")


def _asked(spark, sf) -> DataFrame:
    return read_table(spark, sf, "embeddings").where("vec_id % 20 = 0")


def _approximate(spark, sf) -> DataFrame:
    """Every twentieth row asks an index of all rows."""
    given = read_table(spark, sf, "embeddings")
    return L.approximate_knn(given, "embedding", 10, "vec_id", _asked(spark, sf), block=_GIVEN_BLOCK)


@query("knn_lsh")
def knn_lsh(spark, sf):
    return _approximate(spark, sf).select("row_id", "other", r6("distance"), "place")


@query("knn_lsh_recall", _GIVEN, _knn_sql("given"),
       """SELECT count(DISTINCT row_id) AS n_queries, count(*) AS n_true, true AS is_enough FROM knn WHERE row_id % 20 = 0""")
def knn_lsh_recall(spark, sf):
    """Whether the index finds 0.9 of the true neighbours of the rows that ask."""
    true = _given_knn(spark, sf, "row_id % 20 = 0").select("row_id", "other")
    found = _approximate(spark, sf).select("row_id", "other", F.lit(1).alias("_hit"))
    return true.join(found, ["row_id", "other"], "left").agg(
        F.count_distinct("row_id").alias("n_queries"),
        F.count("*").alias("n_true"),
        (F.sum(F.coalesce("_hit", F.lit(0))) >= 0.9 * F.count("*")).alias("is_enough"),
    )


# The given vectors hold no near copies, so a wide radius is used for them.
_WIDE = 0.85

_NEAR_OUT = """SELECT row_id, round(nearest, 6) AS nearest, round(tanh(nearest), 6) AS score, is_near_duplicate,
  CAST(set_size AS BIGINT) AS set_size, set_first FROM near"""


def _near_out(found: DataFrame) -> DataFrame:
    return found.select("row_id", r6("nearest"), r6("score"), "is_near_duplicate", "set_size", "set_first")


@query("near_duplicates", _GIVEN, _knn_sql("given"), _near_sql(_WIDE), _NEAR_OUT)
def near_duplicates(spark, sf):
    given = read_table(spark, sf, "embeddings")
    return _near_out(N.near_copies(given, "embedding", row_id="vec_id", factor=_WIDE, block=_GIVEN_BLOCK))


@query("near_duplicate_pairs", _GIVEN, _knn_sql("given"), _near_sql(_WIDE), _MEMBERS,
       """SELECT p.row_id, p.other, round(p.distance, 6) AS distance FROM pairs p
          JOIN members a ON a.row_id = p.row_id AND a.first = p.row_id JOIN members b ON b.row_id = p.other AND b.first = p.other
          UNION ALL SELECT row_id, first, CAST(0 AS DOUBLE) FROM members WHERE row_id <> first
          UNION ALL SELECT first, row_id, CAST(0 AS DOUBLE) FROM members WHERE row_id <> first""")
def near_duplicate_pairs(spark, sf):
    """Pairs within the radius, from both ends: between the smallest rows of different vectors, and of these and their copies."""
    links, members = _given_links(spark, sf)
    copies = members.where("row_id <> first").select("row_id", F.col("first").alias("other"), F.lit(0.0).alias("distance"))
    one_way = links.unionByName(copies)
    both = one_way.unionByName(one_way.select(F.col("other").alias("row_id"), F.col("row_id").alias("other"), "distance"))
    return both.select("row_id", "other", r6("distance"))


@query("near_duplicate_members", _GIVEN, _knn_sql("given"), _MEMBERS, "SELECT row_id, first FROM members")
def near_duplicate_members(spark, sf):
    """Every row with a vector, and the smallest row that has the same one: whom the pairs stand for."""
    return _given_links(spark, sf)[1]


def _given_links(spark, sf) -> tuple[DataFrame, DataFrame]:
    given = read_table(spark, sf, "embeddings")
    radius = N.usual_radius(N.knn(given, "embedding", 1, "vec_id", _GIVEN_BLOCK), _WIDE)
    return N.links_within(given, "embedding", radius, "vec_id", _GIVEN_BLOCK)


_REACHED = """reached AS (
  SELECT row_id, row_id AS root FROM {points}
  UNION
  SELECT p.other, r.root FROM reached r JOIN pairs p ON p.row_id = r.row_id)"""


@query("near_duplicate_components", "RECURSIVE " + _GIVEN, _knn_sql("given"), _near_sql(_WIDE), _REACHED.format(points="given"),
       "SELECT row_id, min(root) AS component FROM reached GROUP BY row_id")
def near_duplicate_components(spark, sf):
    """The smallest row that each row can reach by steps within the radius."""
    given = read_table(spark, sf, "embeddings")
    radius = N.usual_radius(N.knn(given, "embedding", 1, "vec_id", _GIVEN_BLOCK), _WIDE)
    return N.near_copy_components(given, "embedding", radius, "vec_id", _GIVEN_BLOCK)


@query("near_dup_text_kept", "RECURSIVE " + _WORDS, _POOLED, """packed AS (SELECT row_id, list(x ORDER BY d) AS v FROM dims GROUP BY row_id)""",
       _knn_sql("packed"), _near_sql(0.13), _REACHED.format(points="packed"),
       """SELECT doc_id AS row_id FROM documents LEFT JOIN (SELECT row_id, min(root) AS root FROM reached GROUP BY row_id) r
          ON r.row_id = doc_id WHERE root IS NULL OR root = doc_id""")
def near_dup_text_kept(spark, sf):
    """The documents left when the smallest one of each chain of near copies stays."""
    vectors = store(_doc_vectors(spark, sf), "document-vectors")
    radius = N.usual_radius(N.knn(vectors, "vector", 1, block=_DOC_BLOCK))
    found = N.near_copy_components(vectors, "vector", radius, block=_DOC_BLOCK)
    return N.keep_first_of_components(_docs(spark, sf).select("row_id"), found)


@query(
    "exclude_near_dups",
    _GIVEN,
    _knn_sql("given"),
    _near_sql(_WIDE),
    "SELECT row_id, label FROM given WHERE row_id NOT IN (SELECT row_id FROM near WHERE is_near_duplicate)",
)
def exclude_near_dups(spark, sf):
    given = read_table(spark, sf, "embeddings")
    found = N.near_copies(given, "embedding", "vec_id", _WIDE, block=_GIVEN_BLOCK)
    rows = given.select(F.col("vec_id").alias("row_id"), "label")
    return N.drop_near_duplicates(rows, found)


_PACKED = """packed AS (SELECT row_id, list(x ORDER BY d) AS v FROM dims GROUP BY row_id)"""


def near_texts(vectors: DataFrame) -> DataFrame:
    """Near copies among document vectors, by a search within the usual radius."""
    return N.near_copies(vectors, "vector", block=_DOC_BLOCK)


@query("near_dup_text", _WORDS, _POOLED, _PACKED, _knn_sql("packed"), _near_sql(0.13), _NEAR_OUT)
def near_dup_text(spark, sf):
    """Near copies among texts: mean-pooled vectors, the usual radius, every document."""
    return _near_out(near_texts(store(_doc_vectors(spark, sf), "document-vectors")))


# --- texts as sets of shingles ---------------------------------------------------------------------

_SHINGLES = """sets AS MATERIALIZED (
  SELECT row_id, list_sort(list_distinct(CASE WHEN len(toks) < {width} THEN [array_to_string(toks, ' ')]
    ELSE list_transform(range(1, len(toks) - {width} + 2), lambda i: array_to_string(toks[i:i + {width} - 1], ' ')) END)) AS s
  FROM words WHERE len(toks) > 0),
firsts AS MATERIALIZED (SELECT row_id, s, min(row_id) OVER (PARTITION BY s) AS first FROM sets),
entries AS MATERIALIZED (SELECT first, len(s) AS n, unnest(s) AS t FROM firsts WHERE row_id = first),
pairs AS MATERIALIZED (
  SELECT a.first AS row_id, b.first AS other, count(*) / (a.n + b.n - count(*)) AS similarity
  FROM entries a JOIN entries b ON a.t = b.t AND a.first < b.first
  GROUP BY a.first, b.first, a.n, b.n HAVING count(*) + 1e-9 >= {threshold} * (a.n + b.n - count(*)))"""


def _similar(spark, sf) -> tuple[DataFrame, DataFrame]:
    return S.similar_texts(_docs(spark, sf), "content")


@query("shingle_pairs", _WORDS, _SHINGLES.format(width=S.WIDTH, threshold=S.THRESHOLD),
       "SELECT row_id, other, round(similarity, 6) AS similarity FROM pairs")
def shingle_pairs(spark, sf):
    """Documents that share four fifths of their shingles of five words; equal sets are one, their smallest document."""
    return _similar(spark, sf)[0].select("row_id", "other", r6("similarity"))


@query("shingle_components", "RECURSIVE " + _WORDS, _SHINGLES.format(width=S.WIDTH, threshold=S.THRESHOLD),
       """ways AS (SELECT row_id, other FROM pairs UNION ALL SELECT other, row_id FROM pairs)""",
       """reached AS (SELECT first AS row_id, first AS root FROM firsts UNION
          SELECT w.other, r.root FROM reached r JOIN ways w ON w.row_id = r.row_id)""",
       """linked AS (SELECT row_id, count(*) AS n FROM ways GROUP BY row_id)""",
       """SELECT w.row_id, COALESCE(f.first, w.row_id) AS first, COALESCE(l.n, 0) AS n_links, COALESCE(c.component, w.row_id) AS component
          FROM words w LEFT JOIN firsts f ON f.row_id = w.row_id LEFT JOIN linked l ON l.row_id = f.first
          LEFT JOIN (SELECT row_id, min(root) AS component FROM reached GROUP BY row_id) c ON c.row_id = f.first""")
def shingle_components(spark, sf):
    """Every document, the smallest one of the same set, the links of that set, and the smallest document reachable."""
    return S.similar_components(*_similar(spark, sf))


_OUTLIERS = """means AS (SELECT row_id, avg(distance) AS m FROM knn GROUP BY row_id)"""


@query(
    "knn_outliers",
    _GIVEN,
    _knn_sql("given"),
    _OUTLIERS,
    """SELECT row_id, round(m, 6) AS mean_distance, m > 2 * (SELECT median(m) FROM means) AS is_outlier FROM means""",
)
def knn_outliers(spark, sf):
    return N.outlier_scores(_given_knn(spark, sf)).select("row_id", r6("mean_distance"), "is_outlier")


# --- groups by density, and the order of rows -----------------------------------------------------

_DENSE = """core AS (SELECT row_id, max(distance) AS core FROM knn WHERE place <= 5 GROUP BY row_id HAVING count(*) = 5),
cut AS (SELECT median(core) AS c FROM core),
links AS (
  SELECT least(k.row_id, k.other) AS a, greatest(k.row_id, k.other) AS b, min(round(greatest(k.distance, x.core, y.core), 9)) AS d
  FROM knn k JOIN core x ON x.row_id = k.row_id JOIN core y ON y.row_id = k.other WHERE place <= 5 GROUP BY 1, 2),
ways AS (SELECT a, b FROM links, cut WHERE d <= c UNION ALL SELECT b, a FROM links, cut WHERE d <= c),
reached AS (SELECT a AS row_id, a AS root FROM ways UNION SELECT w.b, r.root FROM reached r JOIN ways w ON w.a = r.row_id)"""


@query("density_groups", "RECURSIVE " + _GIVEN, _knn_sql("given"), _DENSE,
       """SELECT k.row_id, min(root) AS "group" FROM (SELECT DISTINCT row_id FROM knn) k
          LEFT JOIN reached r ON r.row_id = k.row_id GROUP BY k.row_id""")
def density_groups(spark, sf):
    """The group of each row by mutual reachability, missing for noise."""
    return D.density_groups(_given_knn(spark, sf))


_KS = """placed AS (SELECT row_id, row_number() OVER (ORDER BY {order}, row_id) AS rank, count(*) OVER () AS total FROM {points}),
gaps AS (
  SELECT abs(a.rank - b.rank) AS near,
         abs(a.rank - 1 - CAST('0x' || substr(md5(concat(k.row_id, ':', k.place)), 1, 12) AS BIGINT) % a.total) AS chance
  FROM knn k JOIN placed a ON a.row_id = k.row_id JOIN placed b ON b.row_id = k.other),
steps AS (
  SELECT gap, sum(sum(a)) OVER (ORDER BY gap) / sum(sum(a)) OVER () AS fa, sum(sum(b)) OVER (ORDER BY gap) / sum(sum(b)) OVER () AS fb
  FROM (SELECT near AS gap, 1 AS a, 0 AS b FROM gaps UNION ALL SELECT chance, 0, 1 FROM gaps) GROUP BY gap),
largest AS (SELECT (SELECT count(*) FROM gaps) AS n, max(abs(fa - fb)) AS statistic FROM steps),
scaled AS (SELECT *, (sqrt(n / 2) + 0.12 + 0.11 / sqrt(n / 2)) * statistic AS x FROM largest),
ordered AS (
  SELECT n, statistic, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(list_sum(list_transform(range(1, 101),
    lambda j: CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * x * x))), 0.0), 1.0) END AS p_value FROM scaled)"""


@query("order_check", _GIVEN, _knn_sql("given"), _KS.format(order="label", points="given"),
       "SELECT n, round(statistic, 6) AS statistic, round(CAST(p_value AS DOUBLE), 6) AS p_value FROM ordered")
def order_check(spark, sf):
    """Whether like vectors stand together when rows are ordered by label."""
    found = D.order_check(_given_knn(spark, sf), read_table(spark, sf, "embeddings"), "label", "vec_id")
    return found.select("n", r6("statistic"), r6("p_value"))


# --- quality report ---------------------------------------------------------------------------------


@query(
    "quality_report",
    V.SCORES,
    _JOINT,
    _RATES,
    _FLAGGED,
    _WORDS,
    _POOLED,
    _PACKED,
    """own_vectors AS (SELECT p.row_id, p.v FROM packed p JOIN scores s ON p.row_id = s.row_id)""",
    _knn_sql("own_vectors"),
    _near_sql(0.13),
    _KS.format(order="row_id", points="own_vectors"),
    _OUTLIERS,
    """own AS (SELECT term, CASE WHEN label = 1 THEN p1 ELSE p0 END AS s FROM scores),
       groups AS (SELECT avg(s) / (SELECT avg(s) FROM own) AS r FROM own GROUP BY term),
       sizes AS (SELECT count(*) AS n FROM scores WHERE label IS NOT NULL GROUP BY label),
       all_rows AS (SELECT count(*) AS n FROM scores)""",
    """SELECT 'label' AS "check", (SELECT count(*) FROM flagged) AS n_issues,
              round(CAST((SELECT count(*) FROM flagged) AS DOUBLE) / (SELECT count(*) FROM scores), 6) AS score
       UNION ALL SELECT 'near_duplicate', count(*) FILTER (WHERE is_near_duplicate),
              round(CAST(count(*) FILTER (WHERE is_near_duplicate) AS DOUBLE) / count(*), 6) FROM near
       UNION ALL SELECT 'outlier', count(*) FILTER (WHERE m > 2 * (SELECT median(m) FROM means)),
              round(CAST(count(*) FILTER (WHERE m > 2 * (SELECT median(m) FROM means)) AS DOUBLE) / count(*), 6) FROM means
       UNION ALL SELECT 'null', (SELECT n FROM all_rows) - (SELECT count(*) FROM own_vectors),
              round(CAST((SELECT n FROM all_rows) - (SELECT count(*) FROM own_vectors) AS DOUBLE) / (SELECT n FROM all_rows), 6)
       UNION ALL SELECT 'class_imbalance', CASE WHEN min(n) / sum(n) < 0.1 / count(*) THEN min(n) ELSE 0 END,
              round(CAST(min(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) FROM sizes
       UNION ALL SELECT 'underperforming_group', count(*) FILTER (WHERE r < 0.9), round(min(r), 6) FROM groups
       UNION ALL SELECT 'order', CAST(p_value < 0.05 AS BIGINT), round(CAST(p_value AS DOUBLE), 6) FROM ordered""",
)
def quality_report(spark, sf):
    """All checks on one set of rows: the scored documents, with their vectors."""
    scored = V.scores(spark, sf)
    rows = store(scored.join(_doc_vectors(spark, sf), "row_id", "left"), "scored")
    return quality_checks(rows, "vector", "term", block=_DOC_BLOCK).select("check", "n_issues", r6("score"))


def quality_checks(
    rows: DataFrame, vector: str, group: str, k: int = 10, factor: float = 0.13, group_floor: float = 0.9,
    block: int = N.BLOCK, order: str = "row_id",
) -> DataFrame:
    """One row per check: name, number of issues, and its score (a share unless noted).

    ``rows`` holds row_id, label, p, the vector and the group. ``score`` of
    ``underperforming_group`` is the lowest mean self-confidence of a group relative
    to all rows, and its issues are groups under ``group_floor``. ``order`` says in which
    order the rows were gathered; the score of that check is the p-value that like rows
    stand together by chance, and a value below 0.05 one issue.
    """
    scores = rows.drop(vector)
    near = N.knn(rows, vector, k, block=block)

    def share(name: str, flags: DataFrame, flag: str) -> DataFrame:
        hits = F.count_if(F.col(flag))
        return flags.agg(
            F.lit(name).alias("check"), hits.alias("n_issues"), (hits / F.count("*")).alias("score")
        )

    n_rows = scores.agg(F.count("*")).scalar()
    n_found = C.suspects(scores).agg(F.count("*").alias("n_issues"))
    label = n_found.select(F.lit("label").alias("check"), "n_issues", (F.col("n_issues") / n_rows).alias("score"))
    present = null_profile(rows.select(vector))
    nulls = present.select(
        F.lit("null").alias("check"),
        (F.col("n_rows") - F.col("n_present")).alias("n_issues"),
        ((F.col("n_rows") - F.col("n_present")) / F.col("n_rows")).alias("score"),
    )
    imbalance = C.imbalance_check(scores).select(
        F.lit("class_imbalance").alias("check"),
        F.when(F.col("is_issue"), F.col("n_rarest")).otherwise(0).cast("bigint").alias("n_issues"),
        F.col("share").alias("score"),
    )
    groups = C.group_performance(scores, group).agg(
        F.lit("underperforming_group").alias("check"),
        F.count_if(F.col("relative") < group_floor).alias("n_issues"),
        F.min("relative").alias("score"),
    )
    parts = [
        label,
        share("near_duplicate", N.near_copies(rows, vector, factor=factor, block=block, nearest=near), "is_near_duplicate"),
        share("outlier", N.outlier_scores(near), "is_outlier"),
        nulls,
        imbalance,
        groups,
        D.order_check(near, rows.where(F.col(vector).isNotNull()), order).select(
            F.lit("order").alias("check"), F.coalesce(F.col("p_value") < 0.05, F.lit(False)).cast("bigint").alias("n_issues"),
            F.col("p_value").alias("score"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
