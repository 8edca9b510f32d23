"""The registered queries of the operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelaudit.llm import bpe, centroids, chat, decontaminate, fertility, mixing, pii, secret_scan, simhash, suffix_dedup
from labelaudit.llm import turn_repair, weak_quality, weighted_sampling
from labelaudit.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_pii_surrogates(spark, sf_dir):
    """Every document with its personal data replaced by surrogates."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    return pii.replace(docs, key="labelaudit").select("doc_id", "text", "n_entities")


@query
def op2_mix_sources(spark, sf_dir):
    """How often the mix takes each document, by weights 1, 2, 3 over the sources."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    counted, names = mixing.copies(docs, lambda t: mixing.cycled_weights(t, "source"))
    return counted.select(
        F.col(names["doc_id"]).alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )


@query
def op3_simhash_components(spark, sf_dir):
    """Fingerprint of 3-word shingles and component within 3 bits, for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    placed = simhash.components(docs, [F.col("doc_id")], shingle=3, radius=3)
    return placed.select(
        "doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), F.col("first").alias("component_id")
    )


@query
def op5_tokenizer_fertility(spark, sf_dir):
    """Base counts of every text, its fertility, and whether it is kept."""
    scored = fertility.score(documents(spark, sf_dir).select("doc_id", "text", "lang"), ["doc_id"])
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return scored.select(*first, "n_tokens", "chars_per_token", "byte_share", "entropy")


@query
def op8_byte_level_bpe(spark, sf_dir):
    """Ids of every text under the public vocabulary, and what they decode to, as digests."""
    return bpe.digests(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])


@query
def op10_secret_automaton(spark, sf_dir):
    """Secrets of every text: counts and digest of the base kinds, and all spans."""
    return secret_scan.digests(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])


@query
def op9_weighted_fingerprints(spark, sf_dir):
    """Fingerprints of every text and its edited text, and how alike they are."""
    return weighted_sampling.compare_with_next(documents(spark, sf_dir).select("doc_id", "text"))


@query
def op6_chat_format(spark, sf_dir):
    """Every conversation formatted, and what its formatted text reads back as."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = F.lit(r"\### Assistant: </turn> ok").alias("text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        hard,
    )
    turns = chat.canonical_turns(chat.row_records(given.unionByName(probe)))
    back = chat.read_back(chat.segments(turns))
    return back.select(F.col("group").cast("long").alias("conv_id"), *back.columns[1:])


@query
def op4_suffix_dedup(spark, sf_dir):
    """Every text without the bytes of 200-byte strings that start anywhere else too."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op7_weak_label_quality(spark, sf_dir):
    """Score of every document by a scorer learnt from weak labels, and whether it is kept."""
    return weak_quality.classify(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"])


@query
def op11_decontaminate(spark, sf_dir):
    """Words of every text that stand in a window of 10 words of a benchmark item, and which items these are."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.report(documents(spark, sf_dir).select("doc_id", "text"), items, ["doc_id"])


@query
def op12_centroid_clusters(spark, sf_dir):
    """Cluster and distance of every usable vector after ten rounds from eight hash-drawn centroids."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return centroids.report(vectors, "embedding", "vec_id", k=8, rounds=10)


@query
def op13_turn_repair(spark, sf_dir):
    """Every conversation, some of whose rows are damaged first: its faults, and its cheapest repair."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return turn_repair.report(turn_repair.damage(given), everyone=given)


ORACLES["op2_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, row_number() OVER ascending AS place,
         (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER before, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM totals
  WINDOW ascending AS (ORDER BY source_size / weight, source NULLS LAST),
         before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (
  SELECT min(place) AS place, arg_min(level, place) AS level FROM levels WHERE weight * level <= 3 * source_size),
targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN l.place < f.place THEN (3 * l.source_size)::DOUBLE ELSE l.weight * f.level END AS target
  FROM levels l, free f),
rates AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
         ('0x' || substr(md5(concat_ws(':', 'mix', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies,
       size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM rates
"""

ORACLES["op6_chat_format"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn ') + length(role) + length('>') + 1 + length(regexp_replace(text, '([\\<#])', '\\\1', 'g'))
           + 1 + length('</turn>') + 1)::BIGINT AS formatted_chars
FROM given GROUP BY conv_id
"""

ORACLES["op11_decontaminate"] = r"""
WITH cut AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS nr, text FROM documents
  UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark),
words AS (
  SELECT kind, id, nr, coalesce(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM cut),
sizes AS (SELECT DISTINCT least(len(w), 10) AS size FROM words WHERE kind = 'b' AND len(w) > 0),
windows AS (
  SELECT DISTINCT least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram, id::VARCHAR AS item
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM words WHERE kind = 'b' AND len(w) > 0)),
places AS (
  SELECT nr, id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT nr, id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE kind = 'd' AND len(w) >= size)),
hits AS (SELECT p.nr, p.size, p.i, item FROM places p JOIN windows b ON p.gram = b.gram AND p.size = b.size),
hit AS (SELECT nr, count(DISTINCT word) AS n_hit FROM (SELECT nr, unnest(range(i, i + size)) AS word FROM hits) GROUP BY nr),
named AS (SELECT nr, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT nr, item FROM hits) GROUP BY nr)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM words w LEFT JOIN hit USING (nr) LEFT JOIN named USING (nr) WHERE w.kind = 'd'
"""


def _rounds_sql(rounds: int) -> str:
    """Each round as tables of its own: the numbers of the centroids, then the assignment by them."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT nr, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT v.nr, c.cluster, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM vectors v, c{i} c) GROUP BY nr)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT cluster, list(m ORDER BY d) AS c FROM (
      SELECT cluster, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
      FROM (SELECT a.cluster, unnest(range(1, 65)) AS d, unnest(v.v) AS x FROM a{i} a JOIN vectors v USING (nr))
      GROUP BY cluster, d) GROUP BY cluster) n USING (cluster))""")
    return ",\n".join(parts)


ORACLES["op12_centroid_clusters"] = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v AS c
  FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM vectors) ORDER BY h, v LIMIT 8),
{_rounds_sql(10)},
final AS (
  SELECT cluster, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c10)
SELECT vec_id, cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a10 JOIN vectors USING (nr) JOIN final USING (cluster)
"""


ORACLES["op13_turn_repair"] = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(name, ''),
              lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 20 AS kind
  FROM named),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS time FROM summed),
ordered AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
                lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM ordered),
turns AS MATERIALIZED (
  SELECT *, final = '' AS blank, final <> '' AND again AS duplicate,
         final <> '' AND NOT again AND final NOT IN ('.', '!', '?') AS truncated FROM seen),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS n,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
moves(state, symbol, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
puts(state, next, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)),
edits AS MATERIALIZED (
  SELECT conv_id, pos, s.state, s.state AS next, 2 AS cost, 'D' AS letter FROM turns, (SELECT DISTINCT state FROM moves) s
  UNION ALL
  SELECT conv_id, pos, state, next, CASE WHEN truncated THEN 5 ELSE 0 END, 'K' FROM turns JOIN moves ON symbol = initial
  WHERE NOT blank AND NOT duplicate
  UNION ALL
  SELECT conv_id, pos, state, next, CASE WHEN truncated THEN 6 ELSE 1 END, 'R' FROM turns, moves
  WHERE symbol <> 's' AND NOT blank AND NOT duplicate),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, next AS state, (5 * n)::BIGINT AS cost, repeat('I', n) AS audit
  FROM conversations, puts WHERE state = 0
  UNION ALL
  SELECT conv_id, pos, state, min(cost), arg_min(audit, (cost, audit)) FROM (
    SELECT e.conv_id, e.pos, p.next AS state, s.cost + e.cost + 5 * p.n AS cost, s.audit || e.letter || repeat('I', p.n) AS audit
    FROM steps s JOIN edits e ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND e.pos = s.pos + 1 AND e.state = s.state
    JOIN puts p ON p.state = e.next) GROUP BY conv_id, pos, state),
ends AS (SELECT conv_id, cost, audit FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC, cost, audit) AS place FROM steps WHERE state IN (0, 3)) WHERE place = 1),
letters AS (SELECT conv_id, i, audit[i] AS letter FROM (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS i FROM ends)),
places AS (
  SELECT *, sum((letter <> 'I')::INTEGER) OVER w AS pos, sum((letter <> 'D')::INTEGER) OVER w AS nr FROM letters
  WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
written AS (
  SELECT l.conv_id, l.i, l.letter, l.nr, t.role, CASE WHEN l.letter = 'I' THEN '' ELSE t.text END AS text,
         max((l.letter = 'K' AND l.nr = 1 AND t.initial = 's')::INTEGER) OVER (PARTITION BY l.conv_id) AS system
  FROM places l LEFT JOIN turns t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.pos = t.pos AND l.letter <> 'I'
  WHERE l.letter <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nr - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                             || ':' || text, chr(10) ORDER BY i) AS whole
  FROM written GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN repaired r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
"""
