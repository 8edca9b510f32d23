"""Benchmark decontamination: windows of test items looked up in every text.

The distinct windows of all items (``WIDTH`` consecutive normalised words; an item of
fewer, but not none, is one window) are broadcast as a sorted array of 64-bit hashes.
A task hashes the windows of its texts with numpy, all texts of a slice at once: a word's
hash is a difference of two running sums of bytes times powers of an odd number, a
window's one of such sums over words. A table of bits rules most windows out, a binary
search the rest but the hits; these are compared word by word with the item's own text,
so no two different windows are ever taken for one.

What is broadcast is bounded: items are dealt into blocks of at most ``BLOCK_BYTES`` of
text (one item more at the end), each block broadcast in a pass of its own. Nearly all
benchmarks are one block. Further passes write the texts with the spans found so far.

Defined results: a missing or empty text has no words, is not hit, and stays. Equal item
ids are one item; items without an id are one item too, listed as an empty string. An
empty benchmark hits nothing; an empty table gives an empty result; equal rows are hit
alike. Columns of ``docs`` pass through, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from labelaudit.llm.frames import shown, slices
from labelaudit.operators.ordering import running_totals
from labelaudit.session import store

WIDTH = 10
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 2 << 20
CHUNK = 1 << 20  # bytes hashed at once
#: Everything in ASCII but digits and letters separates words; A-Z become a-z.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_NORMAL_ARRAY = np.frombuffer(_NORMAL, np.uint8)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def _running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of values times powers, and the powers that undo a start."""
    room = 1 << max(12, int(len(values)).bit_length())
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(_BASE, room)[: len(values)], dtype=np.uint64, out=sums[1:])
    return sums, _powers(_INVERSE, room)


@dataclass
class Words:
    """Normalised words of several texts: where each starts and ends, its hash, and its text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    sums: np.ndarray
    undo: np.ndarray

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the windows of ``width`` words that lie within one text."""
        n = len(self.start) - width + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        h = (self.sums[at + width] - self.sums[at]) * self.undo[at]
        return at, (h ^ (h >> np.uint64(29))) * _MIX

    def window(self, at: int, width: int) -> tuple[bytes, ...]:
        """The words of a window."""
        return tuple(self.data[self.start[at] : self.end[at + width - 1]].tobytes().split())


def read_words(data: np.ndarray, cuts: np.ndarray) -> Words:
    """Words of texts that lie one after another in UTF-8 ``data``, cut at ``cuts``."""
    normal = _NORMAL_ARRAY[data]
    is_word = normal != 32
    first = np.zeros(len(data) + 1, bool)
    first[cuts] = True  # a text's first byte follows no word of the text before
    before = np.concatenate(([False], is_word[:-1])) & ~first[:-1]
    after = np.concatenate((is_word[1:], [False])) & ~first[1:]
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    h = np.empty(len(start), np.uint64)
    parts = np.searchsorted(start, np.arange(0, len(data) + CHUNK, CHUNK)).tolist()
    for a, b in zip(parts, [*parts[1:], len(start)]):
        if a < b:
            low = start[a]
            sums, undo = _running(normal[low : end[b - 1]].astype(np.uint64) + np.uint64(1))
            h[a:b] = (sums[end[a:b] - low] - sums[start[a:b] - low]) * undo[start[a:b] - low]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    text = np.searchsorted(cuts, start, side="right") - 1
    return Words(normal, start, end, text, *_running(h))


class Table:
    """Distinct windows of a block of items: sorted hashes per width, where the words stand, and the items that have them."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        owner = np.array([place[name] for name, _ in items], np.int64)
        cuts = np.cumsum([0, *[len(text) for _, text in items]])
        self.words = read_words(np.frombuffer(b"".join(text for _, text in items), np.uint8), cuts)
        counts = np.bincount(self.words.text, minlength=len(items))
        self.widths = []
        for size in sorted({min(n, width) for n in counts.tolist()} - {0}):
            at, hashes = self.words.windows(size)
            mine = counts[self.words.text[at]] == size if size < width else np.ones(len(at), bool)
            self.widths.append((size, *self._distinct(at[mine], hashes[mine], size, owner)))

    def _distinct(self, at: np.ndarray, hashes: np.ndarray, size: int, owner: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        at, hashes = at[order], hashes[order]
        starts = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        ends = np.append(starts[1:], len(at))
        more: dict[int, list[tuple[int, set[int]]]] = {}  # windows of one hash that several items have, or that differ
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            found: dict[tuple[bytes, ...], tuple[int, set[int]]] = {}
            for i in at[a:b].tolist():
                found.setdefault(self.words.window(i, size), (i, set()))[1].add(int(owner[self.words.text[i]]))
            more[a] = list(found.values())
        bits = max(16, 4 + len(starts).bit_length())
        seen = np.zeros(1 << bits, bool)
        seen[hashes >> np.uint64(64 - bits)] = True
        return bits, seen, hashes[starts], starts, at, owner[self.words.text[at]], more

    def hits(self, words: Words) -> Iterator[tuple[int, int, Iterable[int]]]:
        """(first word, width, places of the items) of every window of the texts that an item has."""
        for size, bits, seen, hashes, starts, at, owner, more in self.widths:
            own, h = words.windows(size)
            maybe = np.flatnonzero(seen[h >> np.uint64(64 - bits)])
            place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            equal = hashes[place] == h[maybe]
            for i, a in zip(own[maybe[equal]].tolist(), starts[place[equal]].tolist()):
                window = words.window(i, size)
                if a in more:
                    for j, items in more[a]:
                        if self.words.window(j, size) == window:
                            yield i, size, items
                elif self.words.window(int(at[a]), size) == window:
                    yield i, size, (int(owner[a]),)


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """Ids, texts and blocks of the items that have words; a block holds ``block_bytes`` and one item more at most."""
    rows = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(text).cast("binary").alias("text")
    )
    rows = rows.where(F.col("text").isNotNull()).distinct()
    placed = running_totals(
        rows.withColumn("key", F.sha2("text", 256)), [], ["key", "name"], {"size": F.octet_length("text").cast("long")}
    )
    before = F.col("size_upto") - F.octet_length("text")
    blocks = store(placed.select("name", "text", F.floor(before / block_bytes).alias("block")), "benchmark")
    last = blocks.agg(F.max("block")).first()[0]
    return blocks, 0 if last is None else int(last) + 1


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Columns ``keep`` of ``docs`` (all by default) as ``_in0``..., then n_words, n_hit, items and spans.

    ``items`` are the distinct ids found as sorted strings, ``spans`` the (start, end) of
    each run of hit words, as UTF-8 bytes of the text, one after another in one array.
    Also returns the hidden names of the kept columns; the text follows as ``_text``.
    """
    keep = docs.columns if keep is None else keep
    state = "n_words long, n_hit long, items array<string>, spans array<long>"
    rows = docs.select(*[docs[c] for c in keep], docs[text])
    names = [f"_in{i}" for i in range(len(keep))]
    empty = F.array().cast("array<string>"), F.array().cast("array<long>")
    rows = rows.toDF(*names, "_text").select(
        *names, F.lit(None).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        empty[0].alias("items"), empty[1].alias("spans"), "_text",
    )
    blocks, n = _blocks(items, item_id, item_text, block_bytes)
    context = docs.sparkSession.sparkContext
    for b in range(max(1, n)):
        # at most ``block_bytes`` and one item
        block = [(r["name"], bytes(r["text"])) for r in blocks.where(F.col("block") == b).select("name", "text").collect()]
        rows = _pass(rows, len(names), context.broadcast(block), width, state, b > 0)
        if b < n - 1:
            rows = store(rows, "decontaminated")
    return rows, names


class _Given:
    """Items that compare equal, so that only their digest decides whether a worker's table still holds."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.items = items

    def __eq__(self, other) -> bool:
        return True

    def __hash__(self) -> int:
        return 0


@lru_cache(maxsize=1)
def _table(key: bytes, given: _Given, width: int) -> Table:
    return Table(given.items, width)


def _digest(items: list[tuple[str, bytes]]) -> bytes:
    whole = hashlib.sha256()
    for name, text in items:
        whole.update(b"%d:%d:" % (len(name), len(text)) + name.encode() + text)
    return whole.digest()


def _pass(rows: DataFrame, n_kept: int, block, width: int, state: str, again: bool) -> DataFrame:
    schema = T.StructType([*rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        table = _table(_digest(block.value), _Given(block.value), width)
        for batch in (part for whole in batches for part in slices(whole, size=SLICE_BYTES)):
            column = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            texts = column if not column.null_count else column.fill_null(b"")
            cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = texts.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[cuts[0] : cuts[-1]] if raw is not None else np.empty(0, np.uint8)
            words = read_words(data, cuts - cuts[0])
            edge = np.zeros(len(words.start) + 1, np.int64)
            found: list[set[int]] = [set() for _ in range(batch.num_rows)]
            for at, size, places in table.hits(words):
                edge[at] += 1
                edge[at + size] -= 1
                found[words.text[at]].update(places)
            hit = np.cumsum(edge[:-1]) > 0
            if again:
                hit |= _covered(words, cuts - cuts[0], batch.column(n_kept + 3))
            old = batch.column(n_kept + 2).to_pylist() if again else [[]] * batch.num_rows
            ids = [sorted({*a, *(table.names[i] for i in f)}) if f else a for a, f in zip(old, found)]
            made = [
                np.bincount(words.text, minlength=batch.num_rows),
                np.bincount(words.text[hit], minlength=batch.num_rows),
                ids,
                _spans(words, hit, cuts - cuts[0], batch.num_rows),
            ]
            fields = [arrow.field(n_kept + i).type for i in range(4)]
            columns = [*batch.columns[:n_kept], *[pa.array(m, t) for m, t in zip(made, fields)], batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, schema)


def _spans(words: Words, hit: np.ndarray, cuts: np.ndarray, n: int) -> list[list[int]]:
    """Starts and ends of the runs of hit words of each text, from the text's first byte."""
    out: list[list[int]] = [[] for _ in range(n)]
    if not hit.any():
        return out
    same = np.concatenate(([False], words.text[1:] == words.text[:-1])) if len(hit) else hit
    begins = hit & ~(np.concatenate(([False], hit[:-1])) & same)
    ends = hit & ~(np.concatenate((hit[1:], [False])) & np.concatenate((same[1:], [False])))
    for a, b in zip(np.flatnonzero(begins).tolist(), np.flatnonzero(ends).tolist()):
        i = words.text[a]
        out[i] += [int(words.start[a] - cuts[i]), int(words.end[b] - cuts[i])]
    return out


def _covered(words: Words, cuts: np.ndarray, spans: pa.Array) -> np.ndarray:
    """Which words lie in spans found before."""
    edge = np.zeros(len(words.data) + 1, np.int64)
    for i, pairs in enumerate(spans.to_pylist()):
        for a, b in zip(pairs[::2], pairs[1::2]):
            edge[cuts[i] + a] += 1
            edge[cuts[i] + b] -= 1
    return np.cumsum(edge)[words.start] > 0


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """All rows and columns of ``docs``, each run of hit words cut out of the text."""
    rows, names = find(docs, items, text, **options)
    # the bytes between the spans: from each end to the next start
    bytes_, size = F.col("_text").cast("binary"), F.octet_length("_text").cast("long")
    starts = F.filter("spans", lambda _, i: i % 2 == 0)
    ends = F.filter("spans", lambda _, i: i % 2 == 1)
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), ends),
        F.concat(starts, F.array(size)),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    part = lambda g: F.decode(F.substring(bytes_, g["a"].cast("int") + 1, (g["b"] - g["a"]).cast("int")), "UTF-8")
    left = F.when(F.size("spans") == 0, F.col("_text")).otherwise(F.array_join(F.transform(gaps, part), ""))
    cut = rows.select(*names, left.alias("_left"))
    return shown(cut, dict(zip(docs.columns, names)), cut["_left"].alias(text))


def remove_documents(docs: DataFrame, items: DataFrame, share: float = 0.0, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of whose words at most ``share`` are hit; with 0 those without a hit."""
    rows, names = find(docs, items, text, **options)
    clean = F.col("n_hit") <= F.coalesce("n_words", F.lit(0)) * F.lit(float(share))
    return shown(rows.where(clean), dict(zip(docs.columns, names)))


def report(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", **options) -> DataFrame:
    """``keep`` columns, n_words, n_hit, the number of items found, the digest of their ids, and whether any word is hit."""
    rows, names = find(docs, items, text, keep=keep, **options)
    return rows.select(
        *[rows[n].alias(c) for n, c in zip(names, keep)],
        rows["n_words"],
        rows["n_hit"],
        F.size(rows["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(rows["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (rows["n_hit"] > 0).alias("contaminated"),
    )
