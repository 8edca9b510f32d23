"""Document fingerprints by consistent weighted sampling.

Terms are the words of a text (ASCII letters lower-cased), weighted by how often they
occur. For each of K samples a term draws, from its own hash, r and c of a Gamma(2, 1)
and b uniform; with weight w, t = floor(ln w / r + b) and its value is
c / (exp(r (t - b)) exp(r)). The smallest value wins, and the sample is the pair
(term, t), kept as 16 bits. Two texts agree in a sample with the probability of their
generalised Jaccard similarity: shared weight over united weight.

A term's values depend on the term and its weight alone, so a Python worker remembers
them for up to ``REMEMBERED`` pairs. Values of a long text are compared in blocks.

Defined results: a text without words, or a missing one, has a fingerprint of its own,
all zeros; equal texts have equal fingerprints; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from labelaudit.llm.frames import map_texts, text_bytes

SAMPLES = 64
REMEMBERED = 1 << 18
_BLOCK = 1 << 12
_HEX = 4


class Sampler:
    """Samples of weighted sets of terms."""

    def __init__(self, samples: int = SAMPLES, seed: int = 1):
        self.samples, self.seed = samples, seed
        self.place: dict = {}
        self.value = np.empty((_BLOCK, samples), np.float32)
        self.digest = np.empty((_BLOCK, samples), np.uint16)
        self.column = np.arange(samples)

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _draws(self, hashes: np.ndarray, which: int) -> np.ndarray:
        """Uniform numbers in (0, 1], one per term and sample."""
        step = (self.column * 5 + which + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((self._mixed(hashes[:, None] + step) >> np.uint64(11)) + np.uint64(1)) * 2.0**-53

    def _sampled(self, terms: list[bytes], weights: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the values, and the digests of (term, t)."""
        h = np.array([xxhash.xxh64_intdigest(t, self.seed) for t in terms], np.uint64)
        r = -np.log(self._draws(h, 0) * self._draws(h, 1))
        c = -np.log(self._draws(h, 2) * self._draws(h, 3))
        b = self._draws(h, 4)
        t = np.floor(np.log(np.array(weights, np.float64))[:, None] / r + b)
        value = np.log(c) - r * (t - b) - r
        pair = h[:, None] + t.astype(np.int64).view(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        return value.astype(np.float32), (self._mixed(pair + self.column.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)

    def _places(self, keys: list[tuple[bytes, int]]) -> np.ndarray:
        new = [k for k in keys if k not in self.place]
        if new:
            if len(self.place) + len(new) > REMEMBERED:
                self.place.clear()
                new = keys
            at, need = len(self.place), len(self.place) + len(new)
            if need > len(self.value):
                size = max(need, min(2 * len(self.value), REMEMBERED))
                self.value = np.concatenate([self.value[:at], np.empty((size - at, self.samples), np.float32)])
                self.digest = np.concatenate([self.digest[:at], np.empty((size - at, self.samples), np.uint16)])
            self.value[at:need], self.digest[at:need] = self._sampled(*zip(*new))
            self.place.update(zip(new, range(at, need)))
        return np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))

    def fingerprint(self, text: bytes) -> bytes:
        """The digests of all samples, two bytes each."""
        keys = list(Counter(text.lower().split()).items())
        best, out = None, np.zeros(self.samples, np.uint16)
        for at in range(0, len(keys), _BLOCK):
            places = self._places(keys[at : at + _BLOCK])
            values = self.value[places]
            first = values.argmin(axis=0)
            least = values[first, self.column]
            digest = self.digest[places[first], self.column]
            out = digest if best is None else np.where(least < best, digest, out)
            best = least if best is None else np.minimum(least, best)
        return out.astype("<u2").tobytes()


@lru_cache(maxsize=2)
def sampler(samples: int, seed: int) -> Sampler:
    """One per Python worker."""
    return Sampler(samples, seed)


def alike(a: bytes, b: bytes) -> float:
    """The share of samples in which two fingerprints agree."""
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", samples: int = SAMPLES, seed: int = 1) -> DataFrame:
    """``keep`` columns and the fingerprint of each text, as hex digits."""

    def run(texts: list[bytes]) -> dict[str, list]:
        return {"fingerprint": [sampler(samples, seed).fingerprint(t).hex() for t in texts]}

    return map_texts(docs, text, keep, "fingerprint string", run)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two hex fingerprints agree."""
    place = F.sequence(F.lit(0), F.lit(samples - 1))
    same = F.filter(place, lambda i: F.substr(a, i * _HEX + 1, F.lit(_HEX)) == F.substr(b, i * _HEX + 1, F.lit(_HEX)))
    return F.size(same) / F.lit(float(samples))


def in_succession(docs: DataFrame, order: str, text: str, per_partition: int = 8) -> DataFrame:
    """Rows (_bucket, _tail, _id, _text) dealt so that every row's successor follows it.

    Rows are in ascending order of ``order``, missing values last, equal ones by a hash
    of the text. Buckets are ranges of it, and the first row of each bucket comes again
    at the end of the bucket before (the very first after the last), marked ``_tail``.
    Read the partitions' rows as they come: the row after a row is its successor.
    """
    spark = docs.sparkSession
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[order].cast("long").alias("_id"), docs[text].alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    cuts = rows.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf(T.IntegerType())
    def bucket(ids, hashes):
        spread = (hashes.to_numpy(np.int64) >> 56) + 129 + len(cuts)  # rows without an id
        known = np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), side="right")
        return ids.isna().map({True: 1, False: 0}).mul(spread - known).add(known).astype("int32")

    rows = rows.withColumn("_bucket", bucket("_id", "_hash"))
    key = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    heads = rows.groupBy("_bucket").agg(F.min(key).alias("head"))
    order_ = Window.orderBy("_bucket")  # a row per bucket
    before = F.coalesce(F.lag("_bucket").over(order_), F.max("_bucket").over(Window.partitionBy(F.lit(0))))
    heads = heads.select(F.col("head.id").alias("_hid"), F.col("head.hash").alias("_hhash"), before.alias("_before"))
    rows = rows.join(F.broadcast(heads), F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_hash") == F.col("_hhash")), "left")
    turns = F.array_compact(
        F.array(
            F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("t")),
            F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("b"), F.lit(True).alias("t"))),
        )
    )
    dealt = rows.select("_id", "_text", "_hash", F.explode(turns).alias("_turn"))
    dealt = dealt.select(F.col("_turn.b").alias("_bucket"), F.col("_turn.t").alias("_tail"), "_id", "_text", "_hash")
    ordered = dealt.repartition("_bucket").sortWithinPartitions("_bucket", "_tail", F.asc_nulls_last("_id"), "_hash")
    return ordered.drop("_hash")


def edited_by_next(text: str, following: str) -> str:
    """The second half of ``text`` replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, order: str = "doc_id", text: str = "text", samples: int = SAMPLES, seed: int = 1) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likenesses to that and the next one's."""
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = sampler(samples, seed).fingerprint
        open_ = None  # the row whose successor is still to come: id, text, fingerprint
        for batch in batches:
            out = []
            ids, tails = batch.column("_id").to_pylist(), batch.column("_tail").to_pylist()
            for id_, tail, raw in zip(ids, tails, text_bytes(batch.column("_text"))):
                if tail and open_ is None:
                    continue  # further rows that are equal to the first
                now = id_, raw.decode(), sign(raw)
                if open_ is not None:
                    edited = edited_by_next(open_[1], now[1]).encode()
                    print_ = sign(edited)
                    out.append(
                        (open_[0], len(open_[1]), sha256(edited).hexdigest(), open_[2].hex(), print_.hex(),
                         alike(open_[2], print_), alike(open_[2], now[2]))
                    )
                open_ = None if tail else now
            columns = list(zip(*out)) if out else [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return in_succession(docs, order, text).mapInArrow(run, schema)
