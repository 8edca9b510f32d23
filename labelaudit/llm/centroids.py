"""Centroid clustering of vectors in Hilbert order, with zone maps.

Vectors become whole numbers, so that sums and distances are exact and no result depends
on the order of addition. They are range-partitioned along a Hilbert curve through all
dimensions (equal vectors are told apart by a row number, so a vector held by a third of
all rows is many partitions) and packed into blocks of ``BLOCK`` rows with the smallest
and largest value of each dimension, and their sum. In each round a block's box tells
which centroids can be nearest to any of its vectors: centroid b is out if the box holds
no point that is at least as near to b as to the centroid nearest to the middle of the
box. A block with one candidate adds its stored sum; in the others the vectors are
compared with the candidates, all at once. A round brings one row per centroid back.

Defined results: only vectors with the given number of components, none missing or not
finite, take part. Components are ``floor(scale * x)``, held within 2**26 either way so that
distances fit 64 bits. The first centroids are the vectors with the least digest of
``3:<id>`` (a missing id is empty; equal digests go by the vector); fewer vectors than
``k`` give as many centroids. Equal rows are vectors of their own and go alike. Ties go to
the smaller number. An empty table, or one without a usable vector, gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from labelaudit.llm.frames import hidden, slices
from labelaudit.session import store

BLOCK = 256
SCALE = 1024
LIMIT = 1 << 26
BITS = 4  # of each dimension on the curve
_EXACT = 1 << 21  # products of numbers up to this, summed over 64 dimensions, are exact as float64


def whole(vector: Column, scale: int) -> Column:
    """The vector as whole numbers within the limit."""
    return F.transform(
        vector,
        lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-1e9)), F.lit(1e9))), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"),
    )


def usable(vector: Column, dims: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of ``bits``-bit coordinates, as fixed-width bytes that sort.

    Each level is turned by what the level above has decided: coordinates are exchanged
    with the first one or inverted, then written as a Gray code across the dimensions.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        top, below = 1 << level, (1 << level) - 1
        for d in range(n):
            up = (x[d] & top) != 0
            swap = np.where(up, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(up, below, swap)
            x[d] ^= swap
    for d in range(1, n):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    planes = np.concatenate([(x >> level) & 1 for level in range(bits - 1, -1, -1)])
    return np.packbits(planes.astype(np.uint8), axis=0).T


def _numbers(batch: pa.RecordBatch, column: str, dims: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), dims)


def _keyed(rows: DataFrame, low: np.ndarray, high: np.ndarray, bits: int) -> DataFrame:
    """``rows`` with the place of their vector on the curve; each dimension is cut into equal steps from low to high."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_key", T.BinaryType())])
    step = np.maximum(high - low, 1) / (1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = ((_numbers(batch, "_v", len(low)) - low) / step).astype(np.int64)
            keys = hilbert_key(np.minimum(cells, (1 << bits) - 1), bits)
            made = pa.array([k.tobytes() for k in keys], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return rows.mapInArrow(run, schema)


_BLOCKS = "low binary, high binary, total binary, vectors binary"


def _packed(rows: DataFrame, kept: list[str], dims: int, block: int) -> DataFrame:
    """Runs of ``block`` rows: their box, their sum, their vectors, and their kept columns."""
    fields = [rows.schema[c] for c in kept]
    schema = T.StructType([*T.StructType.fromDDL(_BLOCKS).fields, T.StructField("rows", T.ArrayType(T.StructType(fields)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            vectors = _numbers(batch, "_v", dims).astype("<i4")
            struct = pa.StructArray.from_arrays(
                [batch.column(c).cast(f.type) for c, f in zip(kept, arrow.field("rows").type.value_type)],
                fields=list(arrow.field("rows").type.value_type),
            )
            cuts = [*range(0, batch.num_rows, block), batch.num_rows]
            parts = [vectors[a:b] for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p.min(axis=0).tobytes() for p in parts], pa.binary()),
                    pa.array([p.max(axis=0).tobytes() for p in parts], pa.binary()),
                    pa.array([p.sum(axis=0, dtype="<i8").tobytes() for p in parts], pa.binary()),
                    pa.array([p.tobytes() for p in parts], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), struct).cast(arrow.field("rows").type),
                ],
                schema=arrow,
            )

    return rows.mapInArrow(run, schema)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that are nearest to some point of the box, perhaps with ties, in ascending order.

    d(x, b) - d(x, a) is linear in x, so its least value over the box is at a corner.
    """
    twice_middle = low + high
    a = int(((2 * centroids - twice_middle) ** 2).sum(axis=1).argmin())
    slope = 2 * (centroids[a] - centroids)
    least = (centroids**2).sum(axis=1) - (centroids[a] ** 2).sum() + np.minimum(slope * low, slope * high).sum(axis=1)
    number = np.arange(len(centroids))
    return np.flatnonzero((least < 0) | (least == 0) & (number < a) | (number == a))


def nearest(vectors: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest of the centroids named by ``numbers``, the smaller one on ties, and squared distance."""
    some = centroids[numbers]
    exact = max(int(np.abs(vectors).max(initial=0)), int(np.abs(some).max())) <= _EXACT and vectors.shape[1] <= 64
    kind = np.float64 if exact else np.int64
    v, c = vectors.astype(kind), some.astype(kind)
    apart = (v**2).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c**2).sum(axis=1)
    best = apart.argmin(axis=1)
    return numbers[best], apart[np.arange(len(best)), best].astype(np.int64)


def _box(block: dict, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(block["low"], "<i4").astype(np.int64), np.frombuffer(block["high"], "<i4").astype(np.int64)


def _round(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors nearest to each centroid, and their sums: one row per centroid comes back."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for all_ in batches for part in slices(all_)):
            n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
            for block in batch.to_pylist():
                numbers = candidates(*_box(block, dims), centroids)
                size = len(block["vectors"]) // (4 * dims)
                if len(numbers) == 1:
                    n[numbers[0]] += size
                    sums[numbers[0]] += np.frombuffer(block["total"], "<i8")
                    continue
                vectors = np.frombuffer(block["vectors"], "<i4").reshape(size, dims).astype(np.int64)
                own, _ = nearest(vectors, centroids, numbers)
                for c in numbers.tolist():
                    mine = own == c
                    n[c] += mine.sum()
                    sums[c] += vectors[mine].sum(axis=0)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(list(sums[some]), pa.list_(pa.int64()))],
                names=["cluster", "n", "sums"],
            )

    parts = blocks.drop("rows").mapInArrow(run, "cluster int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect()  # a row per centroid
    return {r["cluster"]: (int(r["n"]), [int(r[f"s{d}"]) for d in range(dims)]) for r in rows}


def _assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The kept columns of each vector, its cluster and squared distance."""
    dims = centroids.shape[1]
    schema = T.StructType([blocks.schema["rows"], *T.StructType.fromDDL("cluster array<int>, distance array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for all_ in batches for part in slices(all_)):
            cluster, distance = [], []
            for block in batch.drop_columns(["rows"]).to_pylist():
                vectors = np.frombuffer(block["vectors"], "<i4").reshape(-1, dims).astype(np.int64)
                own, apart = nearest(vectors, centroids, candidates(*_box(block, dims), centroids))
                cluster.append(own.astype(np.int32))
                distance.append(apart)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rows"), pa.array(cluster, pa.list_(pa.int32())), pa.array(distance, pa.list_(pa.int64()))],
                names=schema.names,
            )

    found = blocks.select("rows", *[f.name for f in T.StructType.fromDDL(_BLOCKS).fields]).mapInArrow(run, schema)
    each = found.select(F.inline(F.arrays_zip("rows", "cluster", "distance")))
    return each.select("rows.*", "cluster", "distance")


def cluster(
    df: DataFrame,
    vector: str = "embedding",
    row_id: str = "vec_id",
    keep: list[str] | None = None,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = SCALE,
    seed: str = "3",
    block: int = BLOCK,
) -> tuple[DataFrame, list[list[int]]]:
    """Columns ``keep`` (all by default) of each usable row, cluster and distance; and the final centroids.

    The added columns replace kept ones of their names. The result is written once, as
    several readers usually follow.
    """
    keep = df.columns if keep is None else keep
    rows, names = hidden(df.select(*keep, *[c for c in (vector, row_id) if c not in keep]))
    v = F.col(names[vector])
    kept = [names[c] for c in keep if c not in ("cluster", "distance")]
    used = rows.where(usable(v, dims)).select(*kept, F.col(names[row_id]).cast("string").alias("_id"), whole(v, scale).alias("_v"))
    first = (
        used.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("_id", F.lit(""))).cast("binary"), 256).alias("h"), "_v")
        .orderBy("h", "_v").limit(k).collect()
    )
    if not first:
        empty = used.select(*kept, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return _named(empty, names, keep), []
    centroids = np.array([r["_v"] for r in first], np.int64)
    ends = used.agg(*[f(F.col("_v")[d]).alias(f"{f.__name__}{d}") for f in (F.min, F.max) for d in range(dims)]).first()
    low, high = np.array(ends[:dims], np.float64), np.array(ends[dims:], np.float64)
    # numbered as read, which a repeated task repeats: it only spreads equal vectors
    placed = _keyed(used.drop("_id").withColumn("_nr", F.monotonically_increasing_id()), low, high, BITS)
    ordered = placed.repartitionByRange("_key", "_nr").sortWithinPartitions("_key", "_nr").drop("_key", "_nr")
    blocks = store(_packed(ordered, kept, dims, block), "blocks")
    for _ in range(rounds):
        before = centroids.copy()
        for number, (n, sums) in _round(blocks, centroids).items():
            centroids[number] = [s // n for s in sums]
        if (centroids == before).all():
            break  # every further round gives the same
    done = store(_assigned(blocks, centroids), "assigned")
    return _named(done, names, keep), centroids.tolist()


def _named(df: DataFrame, names: dict[str, str], keep: list[str]) -> DataFrame:
    own = [F.col(names[c]).alias(c) for c in keep if c not in ("cluster", "distance")]
    return df.select(*own, "cluster", "distance")


def report(df: DataFrame, vector: str = "embedding", row_id: str = "vec_id", **options) -> DataFrame:
    """Per usable vector: id, cluster, distance, sums of the distances, and the digest of its final centroid.

    Sums beyond 64 bits are held at the largest such number.
    """
    done, centroids = cluster(df, vector, row_id, [row_id], **options)
    done = done.toDF("_id", "cluster", "distance")
    # a row per centroid
    sums = {r[0]: int(r[1]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    most = (1 << 63) - 1
    inertia = min(sum(sums.values()), most)
    known = [
        (i, min(sums[i], most), inertia, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(centroids)
        if i in sums
    ]
    table = done.sparkSession.createDataFrame(
        known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return done.join(F.broadcast(table), "cluster").select(
        F.col("_id").alias(row_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
