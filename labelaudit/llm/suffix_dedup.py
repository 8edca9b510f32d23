"""Suffix-array dedup: remove bytes of long strings that start anywhere else too.

A sparse suffix array finds them. Of every window of 200 bytes the position with the
least hash among its 48-byte grams is the window's anchor; equal windows have equal
anchors at equal offsets, so only anchors with the same gram need comparing, about one
position in eighty. An anchor keeps the range of windows that it stands for, and the
bytes of these windows, to the left and to the right of it, are its context.

1. Anchors (gram hash, context hash, document, place) are written out; grams that occur
   once fall away. Equal contexts of a gram are counted as one row, so copies held by
   a third of all rows meet in partial aggregates only.
2. Per gram, one context of each kind is fetched from its text. Their right sides and,
   reversed, their left sides are sorted deep-shallow: multikey quicksort over 8-byte
   characters to a shallow depth, and blind tries for what still has the same prefix.
   With the common prefixes of neighbours in both orders, a window at offset o occurs
   twice exactly when two contexts agree o bytes to the left and 200 - o to the right.
3. The windows found go back to all members of the context, and each text loses the
   union of its windows.

A gram with more than ``group`` different contexts (a line that very many documents
share) is not sorted in one task: its anchors are split by blocks of 32 offsets, keyed by
the 169 bytes that all windows of a block share, and where that is still too much by
single windows, whose key is the whole string. This is exact and needs one text pass each.

Defined results: a missing text is empty; a text shorter than a window loses nothing;
equal rows are documents of their own, so each loses what the other has; an empty
table gives an empty result. Matches never cross documents; removed bytes may cut a
UTF-8 character, so what remains is given as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from labelaudit.llm.frames import hidden, shown, slices, text_bytes
from labelaudit.session import settle, store

WIDTH = 200
GRAM = 48
GROUP = 1 << 13
SHALLOW = 32
_CHARS = 8
_CHUNK = 1 << 18
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
ANCHORS = "k1 long, k2 int, gram long, context long, place long"


# -- anchors ---------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, modulo 2**64."""
    both = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        step = np.full(n, b, np.uint64)
        step[0] = 1
        both.append(np.multiply.accumulate(step))
    return both[0], both[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    up, down = _powers(_CHUNK * 2)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each one on."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, offset, bytes) of about a chunk; pieces of a long text overlap by a window."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - WIDTH + 1), _CHUNK):
            piece = text[at : at + _CHUNK + WIDTH - 1]
            if len(piece) < WIDTH:
                continue
            if group and size + len(piece) > _CHUNK + WIDTH:
                yield group
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield group


def _packed(start, left, more):
    """Where an anchor's windows are: first start, anchor minus first start, starts after the first."""
    return start << 16 | left << 8 | more


def find_anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Text number, gram, context and place of all anchors of ``texts``."""
    found: dict[str, list] = {"text": [], "gram": [], "context": [], "place": []}
    for group in _pieces(texts):
        line = b"".join(p for _, _, p in group)
        sizes = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(sizes)
        hashes = _gram_hashes(np.frombuffer(line, np.uint8))
        order = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_window_minima(order, WIDTH - GRAM + 1) & _PLACE).astype(np.int64)
        starts = np.arange(len(anchor))
        piece = np.searchsorted(ends, starts, side="right")
        inside = starts + WIDTH <= ends[piece]
        starts, piece, anchor = starts[inside], piece[inside], anchor[inside]
        new = np.flatnonzero(np.diff(anchor, prepend=-1) | np.diff(piece, prepend=-1))
        last = np.append(new[1:], len(starts)) - 1
        first, left, more = starts[new], anchor[new] - starts[new], starts[last] - starts[new]
        view, seeds = memoryview(line), (left << 8 | more).tolist()
        context = [
            xxhash.xxh64_intdigest(view[a:b], s)
            for a, b, s in zip(first.tolist(), (first + more + WIDTH).tolist(), seeds)
        ]
        number = np.array([i for i, _, _ in group])[piece[new]]
        shift = (np.array([at for _, at, _ in group]) - (ends - sizes))[piece[new]]
        found["text"].append(number)
        found["gram"].append(hashes[anchor[new]].view(np.int64))
        found["context"].append(np.array(context, np.uint64).view(np.int64))
        found["place"].append(_packed(first + shift, left, more))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}


def _anchor_table(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = find_anchors(text_bytes(batch.column("_text")))
            at = pa.array(found.pop("text"))
            keys = [batch.column("k1").take(at), batch.column("k2").take(at)]
            yield pa.RecordBatch.from_arrays(
                [*keys, *[pa.array(v, pa.int64()) for v in found.values()]], names=["k1", "k2", *found]
            )

    return rows.select("k1", "k2", "_text").mapInArrow(run, ANCHORS)


def _split_anchors(rows: DataFrame, hot: DataFrame, block: int) -> DataFrame:
    """Anchors of too common grams, one per block of offsets, keyed by what all its windows share."""
    # equal rows have equal anchors: the list of one of them is what each of them asks for
    asked = hot.select("k1", "k2", "gram", "place").distinct()
    asked = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "place")).alias("asked"))
    given = rows.select("k1", "k2", "_text").join(asked.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "_text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            out = []
            for k1, k2, text, asked_ in zip(
                batch.column("k1").to_pylist(), batch.column("k2").to_pylist(),
                text_bytes(batch.column("_text")), batch.column("asked").to_pylist(),
            ):
                for a in asked_:
                    start, left, more = a["place"] >> 16, a["place"] >> 8 & 255, a["place"] & 255
                    anchor = start + left
                    for b in range((left - more) // block, left // block + 1):
                        low, high = max(left - more, b * block), min(left, b * block + block - 1)
                        shared = text[anchor - b * block : anchor - (b * block + block - 1) + WIDTH]
                        gram = xxhash.xxh64_intdigest(shared, (a["gram"] + b) & 0xFFFFFFFFFFFFFFFF)
                        own = text[anchor - high : anchor - low + WIDTH]
                        context = xxhash.xxh64_intdigest(own, high << 8 | high - low)
                        out.append((k1, k2, gram, context, _packed(anchor - high, high, high - low)))
            columns = list(zip(*out)) if out else [()] * 5
            signed = [np.array(c, np.uint64).view(np.int64) for c in columns[2:4]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                 *[pa.array(s) for s in signed], pa.array(columns[4], pa.int64())],
                names=["k1", "k2", "gram", "context", "place"],
            )

    return given.mapInArrow(run, ANCHORS)


# -- deep-shallow sorting --------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _blind_trie(strings: list[bytes], ids: list[int]) -> list[int]:
    """Order of strings with a long common prefix, by a trie that keeps branching depths only."""
    root: list = [-1, [ids[0]]]  # a leaf: -1 and its ids; a branch: depth and children by byte
    for i in ids[1:]:
        s = strings[i]
        node, path = root, []
        while node[0] >= 0:
            path.append(node)
            depth, children = node
            node = children.get(s[depth] if depth < len(s) else -1) or next(iter(children.values()))
        t = strings[node[1][0]]
        same = common_prefix(s, t)
        if same == len(s) == len(t):
            node[1].append(i)
            continue
        mine, theirs = (s[same] if same < len(s) else -1), (t[same] if same < len(t) else -1)
        above = None
        for node in [*path, node]:
            if node[0] >= same or node[0] < 0:
                break
            above = node
        if node[0] == same:
            node[1][mine] = [-1, [i]]
            continue
        branch = [same, {mine: [-1, [i]], theirs: node}]
        if above is None:
            root = branch
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = branch
    out, stack = [], [root]
    while stack:
        depth, inside = stack.pop()
        if depth < 0:
            out += inside
        else:
            stack += [inside[k] for k in sorted(inside, reverse=True)]
    return out


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order, and the length of the common prefix with the string before (0 for the first)."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) < 2:
            out += ids
        elif depth >= SHALLOW:
            out += _blind_trie(strings, ids)
        else:
            chars = [strings[i][depth : depth + _CHARS] for i in ids]
            pivot = chars[len(ids) // 2]
            same = [i for i, c in zip(ids, chars) if c == pivot]
            stack.append(([i for i, c in zip(ids, chars) if c > pivot], depth))
            # a character cut short is the end of the string: all of them are equal
            stack.append((same, depth + _CHARS if len(pivot) == _CHARS else len(strings[same[0]]) + SHALLOW))
            stack.append(([i for i, c in zip(ids, chars) if c < pivot], depth))
    return out, [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(out, out[1:])]


def repeated_offsets(contexts: list[tuple[int, int, int, bytes]]) -> list[list[tuple[int, int]]]:
    """For contexts (count, left, more, bytes) of one gram: ranges of offsets whose windows repeat.

    A window at offset o starts o bytes before the anchor; a context has the offsets
    from left - more to left. Contexts differ; one that counts twice repeats as a whole.
    """
    n = len(contexts)
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if n > 1:
        right, right_same = deep_shallow([text[left:] for _, left, _, text in contexts])
        back, back_same = deep_shallow([text[:left][::-1] for _, left, _, text in contexts])
        right_same, back_same = np.array(right_same), np.array(back_same)
        lowest = min(left - more for _, left, more, _ in contexts)
        highest = max(left for _, left, _, _ in contexts)
        turns = np.unique(np.concatenate([[lowest], WIDTH - right_same[1:], back_same[1:] + 1]))
        turns = turns[(turns >= lowest) & (turns <= highest)].tolist()
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        for low, high in zip(turns, [*[t - 1 for t in turns[1:]], highest]):
            a[right] = np.cumsum(right_same < WIDTH - low)
            b[back] = np.cumsum(back_same < low)
            _, kind, size = np.unique(a * (n + 1) + b, return_inverse=True, return_counts=True)
            for i in np.flatnonzero(size[kind] > 1).tolist():
                found[i].append((low, high))
    out = []
    for (count, left, more, _), ranges in zip(contexts, found):
        own = [(left - more, left)] if count > 1 else ranges
        cut = [(max(a, left - more), min(b, left)) for a, b in own]
        out.append([(a, b) for a, b in cut if a <= b])
    return out


# -- the operator ----------------------------------------------------------------------


def _contexts(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """One context of each kind: gram, context, count, left, more, bytes."""
    asked = kinds.select("rep.k1", "rep.k2", F.struct("gram", "context", "count", "rep.place").alias("a"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_list("a").alias("_asked"))
    given = rows.join(asked.hint("shuffle_hash"), ["k1", "k2"])
    batch_text = given.columns.index("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, batch_text)):
            out = []
            for text, asked_ in zip(text_bytes(batch.column("_text")), batch.column("_asked").to_pylist()):
                for a in asked_:
                    start, left, more = a["place"] >> 16, a["place"] >> 8 & 255, a["place"] & 255
                    out.append((a["gram"], a["context"], a["count"], left, more, text[start : start + more + WIDTH]))
            columns = list(zip(*out)) if out else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            names = ["gram", "context", "count", "left", "more", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return given.mapInArrow(run, "gram long, context long, count long, left int, more int, bytes binary")


def _sorted_groups(contexts: DataFrame) -> DataFrame:
    """Per kind of context, the offsets whose windows repeat: gram, context, ranges (low << 8 | high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, group = None, {}

        def closed(out):
            if group:
                for context, ranges in zip(group, repeated_offsets(list(group.values()))):
                    if ranges:
                        out.append((gram, context, [a << 8 | b for a, b in ranges]))

        def record(out):
            columns = list(zip(*out)) if out else [()] * 3
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["gram", "context", "ranges"]
            )

        for batch in batches:
            out = []
            for g, c, *rest in zip(*[column.to_pylist() for column in batch.columns]):
                if g != gram:
                    closed(out)
                    gram, group = g, {}
                group[c] = tuple(rest)  # equal rows ask for the same context twice
            yield record(out)
        out = []
        closed(out)
        yield record(out)

    dealt = contexts.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "gram long, context long, ranges array<int>")


def _round(anchors: DataFrame, group: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Members of repeated grams, the kinds of their contexts, and the members of too common grams, if any."""
    # written before the join, so that Spark can split a gram that holds a large part of the anchors
    often = settle(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    members = store(anchors.join(often, "gram"), "members")
    kinds = members.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct("k1", "k2", "place")).alias("rep")
    )
    kinds = store(kinds, "kinds")
    common = settle(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(f"n > {group}").select("gram"))
    if common.isEmpty():
        return members, kinds, None
    rest = members.join(common, "gram", "left_anti")
    return rest, kinds.join(common, "gram", "left_anti"), members.join(common, "gram", "left_semi")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> tuple[DataFrame, dict]:
    """Hidden columns of ``docs``, the text as ``_text``, and ``_removed``: (from, to) of repeated windows."""
    rows, names = hidden(docs)
    id_, text_ = F.col(names[doc_id]), F.col(names[text])
    whole = dict(rows.dtypes)[names[doc_id]] in ("bigint", "int", "smallint", "tinyint")
    # a row without an id goes by its text, in 96 bits with k2; not nullable, as a filter of missing keys
    # in one of the two joins of texts would have them shuffled twice
    k1 = F.coalesce(id_.cast("long") if whole else F.when(id_.isNotNull(), F.xxhash64(id_)), F.xxhash64(text_))
    rows = rows.select("*", k1.alias("k1"), F.hash(id_, text_).alias("k2"), text_.alias("_text"))
    anchors = store(_anchor_table(rows), "anchors")
    members, kinds = [], []
    for block in (32, 1, None):
        m, k, hot = _round(anchors, group if block else 1 << 62)
        members.append(m)
        kinds.append(k)
        if hot is None:
            break
        anchors = store(_split_anchors(rows, hot, block), "anchors")
    all_members, all_kinds = members[0], kinds[0]
    for m, k in zip(members[1:], kinds[1:]):
        all_members, all_kinds = all_members.union(m), all_kinds.union(k)
    ranges = _sorted_groups(_contexts(rows, all_kinds))
    anchor = F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(255)
    found = all_members.join(ranges, ["gram", "context"]).select(
        "k1", "k2", anchor.alias("anchor"), F.explode("ranges").alias("r")
    )
    spans = found.select(
        "k1", "k2",
        F.struct(
            (F.col("anchor") - F.col("r").bitwiseAND(255)).alias("from"),
            (F.col("anchor") - F.shiftright("r", 8) + WIDTH).alias("to"),
        ).alias("span"),
    ).groupBy("k1", "k2").agg(F.collect_set("span").alias("_removed"))
    return rows.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left"), names


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What remains, bytes removed, and how many runs they form."""
    out, at, runs, gone = [], 0, 0, 0
    end = 0
    for low, high in sorted(spans):
        if low > end or not runs:
            out.append(text[at:low])
            runs, at, end = runs + 1, low, low
        if high > end:
            gone += high - end
            at = end = high
    return b"".join([*out, text[at:]]), gone, runs


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All columns of ``docs``, kept (bytes), n_bytes, n_removed and n_spans."""
    found, names = repeats(docs, doc_id, text, **options)
    batch_text = found.columns.index("_text")
    kept = list(names.values())
    schema = found.select(*kept).schema
    for name, kind in (("kept", "binary"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, batch_text)):
            texts = text_bytes(batch.column("_text"))
            spans = [[(s["from"], s["to"]) for s in x or []] for x in batch.column("_removed").to_pylist()]
            rest, gone, runs = zip(*map(without, texts, spans)) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(rest, pa.binary()), pa.array(map(len, texts), pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(runs, pa.int64())],
                names=schema.names,
            )

    made = found.mapInArrow(run, schema)
    return shown(made, names, "kept", "n_bytes", "n_removed", "n_spans")
