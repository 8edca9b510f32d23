"""Exact similarity join of texts by their word shingles.

Texts are sets of shingles (hashes of ``WIDTH`` words in a row; a text of fewer words is
one shingle). Equal sets are one, with members. A pair of sets whose Jaccard similarity is
at least ``threshold`` shares a shingle among the first few of both, in any order common to
all sets: so only these prefixes are joined, with common shingles last. The order goes by how
many entries the shingle's bucket has, of ``BUCKETS`` in all, then by hash: a common shingle
makes its bucket full, and no shingle needs a count of its own. Pairs that meet must also
agree in length, in the number of shingles left after the place where they meet, and in a bit
sketch of the sets (each shingle toggles one of ``SKETCH`` bits, so two sets differ in as many
shingles as bits, at least); those left are compared shingle by shingle.

Sets are written once and stay where they are. Only their prefixes and sketches meet the ids
that stand for equal sets, a prefix is shuffled once by shingle, and for the comparison only
sets that are in a pair move, each to the smallest row it may be like (``home``), where all
its pairs are, rather than to every pair.

A shingle that very many sets have in their prefix is no single task: its rows are dealt
into parts of about ``PART`` rows, and every two parts meet in a task of their own; so are
the sets of a home with more than ``ROOM``. No pair is lost, whatever its shingles.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from labelaudit.operators.assemble import salted_join
from labelaudit.operators.components import connected
from labelaudit.operators.features import tokens
from labelaudit.session import settle, store

WIDTH = 5
THRESHOLD = 0.8
PART = 2048
ROOM = 512
BUCKETS = 1 << 18
MARKS = 1 << 22
SKETCH = 512
_SOME = 1 << 17  # pairs given out at once
_EPS = 1e-9


def shingles(text: Column | str, width: int = WIDTH) -> Column:
    """Hashes of the shingles of a text, each once, in ascending order; none without words."""
    words = tokens(text)

    def of(own: Column) -> Column:
        n = F.size(own)
        whole = F.array(F.xxhash64(F.array_join(own, " ")))
        starts = F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1)))
        runs = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(own, i, width), " ")))
        none = F.array().cast("array<bigint>")
        return F.when(n == 0, none).when(n < width, whole).otherwise(F.array_sort(F.array_distinct(runs)))

    # a variable, so that the text is taken apart once
    return F.transform(F.array(words), of)[0]


def distinct_sets(
    df: DataFrame, text: str, row_id: str = "row_id", width: int = WIDTH
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(first, s) of all rows, (first) of the rows that stand for their set, and (row_id, first) of all rows.

    A row without words is alone. Groups are formed on hashes, with partial aggregation; sets do not move.
    """
    sets = store(df.select(F.col(row_id).cast("bigint").alias("row_id"), shingles(text, width).alias("s")), "sets")
    key = F.struct(F.xxhash64("s").alias("a"), F.xxhash64("s", F.lit(1)).alias("b"), F.size("s").alias("n"))
    keyed = sets.where(F.size("s") > 0).select("row_id", key.alias("_k"))
    firsts = settle(keyed.groupBy("_k").agg(F.min("row_id").alias("first"), F.count("*").alias("_n")))
    alone = firsts.where("_n = 1").select(F.col("first").alias("row_id"), "first")
    several = salted_join(keyed, firsts.where("_n > 1").select("_k", "first"), "_k", "row_id").select("row_id", "first")
    none = sets.where(F.size("s") == 0).select("row_id", F.col("row_id").alias("first"))
    return sets.withColumnRenamed("row_id", "first"), firsts.select("first"), alone.union(several).union(none)


def _fullness(sets: DataFrame, buckets: int) -> np.ndarray:
    """How many entries of the sets are in each bucket of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            own = batch.column("s").flatten().to_numpy(zero_copy_only=False)
            n += np.bincount(own & (buckets - 1), minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["bucket", "n"])

    rows = sets.select("s").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros(buckets, np.int64)
    full[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return full


def _least_overlap(a: Column, b: Column, threshold: float) -> Column:
    return F.ceil((a + b) * F.lit(threshold / (1 + threshold)) - _EPS)


def _prefixes(sets: DataFrame, full: np.ndarray, threshold: float, part: int) -> DataFrame:
    """(first, size, t, rare, k): each set's prefix, the rarest shingles first, and its sketch.

    The first ``rare`` shingles are in buckets that are no fuller than a part, or than twice the mean.
    """
    shared = sets.sparkSession.sparkContext.broadcast(full)
    most = max(part, 2 * int(full.sum()) // len(full))
    schema = T.StructType.fromDDL("first long, size int, t array<long>, rare int, k array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            sizes, prefix, rare, sketch = [], [], [], []
            for own in batch.column("s"):
                own = own.values.to_numpy(zero_copy_only=False)
                n = often[own & (len(often) - 1)]
                order = np.lexsort((own, n))[: len(own) - math.ceil(threshold * len(own) - _EPS) + 1]
                sizes.append(len(own))
                prefix.append(own[order])
                rare.append(np.searchsorted(n[order], most, side="right"))
                sketch.append(np.packbits(np.bincount(own >> 40 & (SKETCH - 1), minlength=SKETCH) & 1).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("first"), pa.array(sizes, pa.int32()), pa.array(prefix, longs), pa.array(rare, pa.int32()),
                 pa.array(sketch, longs)],
                names=schema.names,
            )

    return sets.where(F.size("s") > 0).select("first", "s").mapInArrow(run, schema)


def _unique_pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*found)) or ((), ())))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["row_id", "other"])


def _meeting(posts: DataFrame, threshold: float) -> DataFrame:
    """(row_id, other) of rows of (t, first, size, place) with the same shingle that may be similar; some more than once."""

    def near(group: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first, size, place = group
        step = max(1, (1 << 20) // len(first))
        for low in range(0, len(first), step):
            n, a, at = size[low : low + step, None], first[low : low + step, None], place[low : low + step, None]
            need = np.ceil((n + size) * (threshold / (1 + threshold)) - _EPS)
            fit = (a < first) & (np.minimum(n, size) + _EPS >= np.maximum(n, size) * threshold)
            x, y = np.nonzero(fit & (np.minimum(n - at, size - place) >= need))
            yield first[low + x], first[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, found, n_found = None, [], 0
        for batch in itertools.chain(batches, [None]):
            columns = [] if batch is None else [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if kept is not None:
                columns = [np.concatenate(c) for c in zip(kept, columns)] if columns else kept
            if not columns or not len(columns[0]):
                continue
            cuts = np.flatnonzero(np.diff(columns[0])) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(columns[0]))
            if batch is not None:  # the last shingle may go on
                kept = [c[starts[-1] :] for c in columns]
                starts, ends = starts[:-1], ends[:-1]
            for i in np.flatnonzero(ends - starts > 1):
                for pair in near([c[starts[i] : ends[i]] for c in columns[1:]]):
                    found.append(pair)
                    n_found += len(pair[0])
                if n_found > _SOME:
                    yield _unique_pairs(found)
                    found, n_found = [], 0
        yield _unique_pairs(found)

    dealt = posts.select("t", "first", "size", "place").repartition("t").sortWithinPartitions("t")
    return dealt.mapInArrow(run, "row_id long, other long")


def _meeting_in_parts(posts: DataFrame, threshold: float, part: int) -> DataFrame:
    """The same of shingles that very many rows may have, each dealt into as many parts as its rows ask for."""
    heavy = posts.groupBy("t").agg(F.ceil(F.count("*") / F.lit(part)).cast("int").alias("_n")).where("_n > 1")
    own = salted_join(posts, heavy, "t", "first", "left").withColumn("_g", F.coalesce("_n", F.lit(1)))
    own = own.withColumn("_p", F.pmod(F.xxhash64("first"), F.col("_g")).cast("int"))
    left = own.select(
        "t", F.col("_p").alias("i"), F.explode(F.sequence(F.col("_p"), F.col("_g") - 1)).alias("j"),
        F.col("first").alias("a"), F.col("size").alias("n_a"), F.col("place").alias("at_a"),
    )
    right = own.select(
        "t", F.explode(F.sequence(F.lit(0), F.col("_p"))).alias("i"), F.col("_p").alias("j"),
        F.col("first").alias("b"), F.col("size").alias("n_b"), F.col("place").alias("at_b"),
    )
    need = _least_overlap(F.col("n_a"), F.col("n_b"), threshold)
    left_over = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))  # this shingle and those after it
    met = left.join(right, ["t", "i", "j"]).where(
        ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
        & (F.least("n_a", "n_b") + _EPS >= F.greatest("n_a", "n_b") * F.lit(threshold))
        & (left_over >= need)
    )
    return met.select(F.least("a", "b").alias("row_id"), F.greatest("a", "b").alias("other"))


def _marked(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``sets`` whose ``first`` is in ``wanted``, and few others: found by marks, so that the rest does not move."""
    mark = F.pmod(F.xxhash64("first"), F.lit(MARKS)).cast("int")
    bits = np.zeros(MARKS, np.uint8)
    bits[wanted.select(mark.alias("m")).distinct().toPandas()["m"].to_numpy(np.int64)] = 1
    shared = sets.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for marks in batches:
            m = marks.to_numpy(zero_copy_only=False)
            yield pa.array((shared.value[m >> 3] >> (7 - (m & 7)) & 1).astype(bool))

    return sets.where("first IS NOT NULL").where(F.arrow_udf(run, "boolean")(mark))


def _compared(sets: DataFrame, likely: DataFrame, threshold: float, room: int) -> DataFrame:
    """(row_id, other, similarity) of the pairs (row_id, other, n) that are as similar, ``n`` times each."""
    ends = likely.select("row_id", "other").union(likely.select("other", "row_id"))
    homes = ends.groupBy("row_id").agg(F.least(F.min("row_id"), F.min("other")).alias("home"))
    placed = settle(salted_join(likely, homes, "row_id", "other"))
    guests = placed.select("home", "row_id").union(placed.select("home", "other")).distinct()
    rooms = guests.groupBy("home").agg(F.ceil(F.count("*") / F.lit(room)).cast("int").alias("_g")).where("_g > 1")
    own = salted_join(placed, rooms, "home", "other", "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    of = lambda end: F.pmod(F.xxhash64(end), F.col("_g")).cast("int")
    own = own.select("home", of("row_id").alias("i"), of("other").alias("j"), "row_id", "other", "n")
    at = ["home", "i", "j"]
    asked = own.select(*at, F.col("row_id").alias("first"), F.struct("other", "n").alias("o")).union(
        own.select(*at, F.col("other").alias("first"), F.lit(None).cast("struct<other:bigint,n:bigint>").alias("o"))
    )
    asked = settle(asked.groupBy(*at, "first").agg(F.collect_list("o").alias("others")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, guests, asks = None, {}, {}

        def closed(out):
            for a, others in asks.items():
                for b, n in others:
                    for x in guests[a]:
                        for y in guests.get(b, ()):
                            place = np.minimum(np.searchsorted(y, x), len(y) - 1) if len(y) else x[:0]
                            shared = int(np.count_nonzero(y[place] == x)) if len(y) else 0
                            alike = shared / max(1, len(x) + len(y) - shared)
                            if alike + _EPS >= threshold:
                                out += [(a, b, alike)] * n

        def record(out):
            columns = list(zip(*out)) if out else [()] * 3
            types = [pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["row_id", "other", "similarity"]
            )

        for batch in batches:
            out = []
            keys = zip(*[batch.column(c).to_pylist() for c in at])
            rows = zip(keys, batch.column("first").to_pylist(), batch.column("others").to_pylist(), batch.column("s"))
            for key, first, others, s in rows:
                if key != here:
                    closed(out)
                    here, guests, asks = key, {}, {}
                # a copy, so that the batch goes; rows may have the same id
                guests.setdefault(first, []).append(s.values.to_numpy(zero_copy_only=False).copy())
                if others:
                    asks[first] = [(o["other"], o["n"]) for o in others]
            yield record(out)
        out = []
        closed(out)
        yield record(out)

    moved = asked.join(_marked(sets, asked), "first").select(*at, "first", "others", "s")
    return moved.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, "row_id long, other long, similarity double")


def pairs(
    sets: DataFrame, threshold: float = THRESHOLD, part: int = PART, firsts: DataFrame | None = None, room: int = ROOM,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(row_id, other, similarity) of all pairs of different sets (first, s) that are as similar, ``row_id`` the smaller one.

    With ``firsts``, only sets whose ``first`` is there take part. ``buckets`` is a power of 2.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold is above 0 and at most 1")
    made = _prefixes(sets, _fullness(sets, buckets), threshold, part)
    if firsts is None:
        firsts = sets.select("first").distinct()
    ids = firsts.groupBy("first").agg(F.count("*").alias("times"))
    made = store(made.join(ids, "first"), "prefixes")
    posts = made.select("first", "size", "rare", F.posexplode("t").alias("place", "t"))
    met = _meeting(posts.where("place < rare"), threshold)
    often = made.where(F.size("t") > F.col("rare")).select("first", "size", "rare", F.posexplode("t").alias("place", "t"))
    often = often.where("place >= rare").drop("rare")
    found = met.union(_meeting_in_parts(often, threshold, part)).distinct()
    narrow = made.select("first", "size", "k", "times")
    both = found.join(narrow.toDF("row_id", "n_a", "k_a", "t_a"), "row_id").join(narrow.toDF("other", "n_b", "k_b", "t_b"), "other")
    differ = F.aggregate(F.zip_with("k_a", "k_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    allowed = F.col("n_a") + F.col("n_b") - 2 * _least_overlap(F.col("n_a"), F.col("n_b"), threshold)
    # where ids are repeated, a pair counts for each row and set of both ends
    times = F.count("*") * F.max(F.col("t_a") * F.col("t_b")) * F.max(F.col("t_a") * F.col("t_b"))
    likely = settle(both.where(differ <= allowed).groupBy("row_id", "other").agg(times.alias("n")))
    return _compared(sets, likely, threshold, room)


def similar_texts(
    df: DataFrame, text: str, row_id: str = "row_id", width: int = WIDTH, threshold: float = THRESHOLD, part: int = PART
) -> tuple[DataFrame, DataFrame]:
    """Pairs between the smallest rows of different sets, and every row's smallest row of the same set."""
    sets, firsts, members = distinct_sets(df, text, row_id, width)
    return settle(pairs(sets, threshold, part, firsts)), members


def similar_components(found: DataFrame, members: DataFrame) -> DataFrame:
    """(row_id, first, n_links, component): links of the row's set to different sets, and the smallest row reachable."""
    ends = found.select("row_id").union(found.select("other"))
    links = ends.groupBy(F.col("row_id").alias("node")).agg(F.count("*").alias("n_links"))
    roots = settle(connected(found, "row_id", "other").join(links, "node"))
    placed = salted_join(members, roots, "first", "row_id", "left", key_r="node")
    return placed.select("row_id", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "first").alias("component"))
