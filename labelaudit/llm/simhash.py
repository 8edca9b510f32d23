"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the hashes of a text's word shingles.
To find all pairs within radius r, each bit position gets a vector of r + 1 bits,
and there is one mask per non-zero vector v: it keeps the bits whose vector has
an odd product with v. Whatever r positions differ, their vectors span at most r
dimensions, so some v is orthogonal to all of them, and that mask keeps none of
the differing bits: the pair meets in the table of v. For r = 3 that is 15 tables
of 34 bits, and no pair is missed.

Equal fingerprints are one row before anything else happens. A bucket of a table
with more than ``bucket`` different fingerprints is dealt out again by masks over
the bits its table leaves free (30, then 14, then 7 at r = 3), which is exact for
the same reason; with 7 free bits it holds 128 at most. In a bucket links are
looked for by blocks of numbers, and only a star per connected part leaves the
task, never all pairs. Components come from alternating star contractions on
edges, with tables written between the rounds.

Defined results: a text without words, or a missing one, has fingerprint 0, which
links like any other; equal rows share a component; a missing id is never the
smallest of a component that has another; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from labelaudit.llm.frames import hidden, shown
from labelaudit.session import settle

BITS = 64
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The majority of the XXH64 of all shingles, bit by bit; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space cuts
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(shingle, len(words))
    lo = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    hi = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(lo), _CHUNK):
        part = zip(lo[at : at + _CHUNK], hi[at : at + _CHUNK])
        h = np.array([digest(line[a:b], seed) for a, b in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(lo), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a signed long."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle, seed) for t in texts], dtype="uint64").astype("int64")

    return F.pandas_udf(run, T.LongType())(text)


def fingerprint_hex(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over ``positions``: any ``radius`` of them are all left out by one mask."""
    n = (1 << (radius + 1)) - 1
    vector = {p: 1 + i % n for i, p in enumerate(positions)}
    return [sum(1 << p for p, u in vector.items() if (u & v).bit_count() % 2) for v in range(1, n + 1)]


def _deeper(masks: list[int], radius: int) -> list[int]:
    """Each mask joined with each covering mask of the bits that it leaves free."""
    free = [[p for p in range(BITS) if not m >> p & 1] for m in masks]
    return [m | more for m, bits in zip(masks, free) for more in covering_masks(bits, radius)]


def _longs(masks: list[int]) -> Column:
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    return F.array(*[F.lit(m).cast("long") for m in signed])


def _keyed(rows: DataFrame, masks: list[int], fan: int) -> DataFrame:
    """A row per fingerprint and table below the row's own: table, key, fp."""
    first = F.col("table") * fan
    turn = F.transform(
        F.sequence(F.lit(0), F.lit(fan - 1)),
        lambda v: F.struct(
            (first + v).alias("table"),
            F.col("fp").bitwiseAND(F.element_at(_longs(masks), (first + v + 1).cast("int"))).alias("key"),
        ),
    )
    return rows.select("fp", F.explode(turn).alias("_b")).select("_b.table", "_b.key", "fp")


def _stars(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest) of each part of ``values`` connected by distances in the radius."""
    out: list[tuple[int, int]] = []
    rest = np.sort(values)
    while len(rest) > 1:
        root, front, part = rest[0], rest[:1], []
        rest = rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(front), 64):
                far = np.bitwise_count((front[at : at + 64, None] ^ rest[None, :]).view(np.uint64))
                near |= (far <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            part.extend(front.tolist())
        out.extend((v, int(root)) for v in part)
    return out


def _bucket_edges(buckets: DataFrame, radius: int) -> DataFrame:
    """Edges of stars in buckets of bounded size: a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            values = column.values.to_numpy(zero_copy_only=False)
            cuts = column.offsets.to_numpy()
            edges = [e for lo, hi in zip(cuts[:-1], cuts[1:]) for e in _stars(values[lo:hi], radius)]
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long").distinct()


def near_edges(fps: DataFrame, radius: int = 3, bucket: int = 512) -> DataFrame:
    """Edges that connect all of ``fps`` (distinct, column fp) within ``radius`` bits."""
    masks, fan = [0], (1 << (radius + 1)) - 1
    rows, found = fps.select("fp", F.lit(0).cast("long").alias("table")), []
    while True:
        masks = _deeper(masks, radius)
        keyed = _keyed(rows, masks, fan)
        counts = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))
        free = BITS - min(m.bit_count() for m in masks)
        last = 1 << free <= bucket
        few = counts.where("n > 1" if last else f"n > 1 AND n <= {bucket}")
        grouped = keyed.join(few, ["table", "key"]).groupBy("table", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(settle(_bucket_edges(grouped, radius)))
        if last:
            break
        hot = settle(counts.where(f"n > {bucket}").select("table", "key"))
        if hot.isEmpty():
            break
        rows = settle(keyed.join(hot, ["table", "key"]).select("fp", "table"))
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    return edges


def connected(edges: DataFrame) -> DataFrame:
    """The smallest value reachable, for each value that is not the smallest: a, b.

    Alternates large-star (neighbours above go to the smallest neighbour) and
    small-star (neighbours below go to it) until nothing changes.
    """

    def to_smallest(links: DataFrame, downward: bool) -> DataFrame:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        if not downward:
            least = least.select("a", F.least("a", "m").alias("m"))
        moved = links.where("b > a" if not downward else "b < a").join(least, "a")
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return out.union(least.select("a", F.col("m").alias("b"))) if downward else out

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()

    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while (now := state(edges)) != seen and now[0]:
        seen = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = to_smallest(both, downward=False).distinct()
        edges = settle(to_smallest(large, downward=True).distinct())
    return edges


def components(
    docs: DataFrame,
    keep: list[Column],
    text: str = "text",
    order: str = "doc_id",
    shingle: int = 3,
    radius: int = 3,
    seed: int = 42,
) -> DataFrame:
    """``keep`` of every row, its fingerprint ``fp``, and ``first``, the least ``order`` in reach.

    ``order`` is one of the kept columns; what compares least there, missing values
    aside, names the component.
    """
    rows = settle(docs.select(*keep, fingerprint_column(docs[text], shingle, seed).alias("fp")))
    ids = rows.groupBy("fp").agg(F.min(order).alias("least"))
    ids = settle(ids)
    roots = connected(near_edges(ids, radius))
    rooted = ids.join(roots.withColumnRenamed("a", "fp"), "fp", "left")
    rooted = rooted.select("fp", "least", F.coalesce("b", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return rows.join(rooted.select("fp", "root").join(first, "root").drop("root"), "fp")


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component: the one with the smallest id; all columns pass through.

    Rows with the same id (or none) are told apart by a hash of all columns, and
    of rows equal in all columns one stays.
    """
    rows, names = hidden(docs)
    id_, row_hash = F.col(names[doc_id]), F.xxhash64(*rows.columns)
    mark = F.struct(id_.isNull().alias("none"), id_.alias("id"), row_hash.alias("hash"))
    placed = components(rows, [mark.alias("mark")], names[text], "mark", **options)
    kept = placed.select("first.*").distinct()
    marked = rows.withColumn("_hash", row_hash)
    same = (marked[names[doc_id]].eqNullSafe(kept["id"])) & (marked["_hash"] == kept["hash"])
    out = marked.join(kept, same, "left_semi").dropDuplicates([names[doc_id], "_hash"])
    return shown(out, names)
