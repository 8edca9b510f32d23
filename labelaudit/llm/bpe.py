"""Byte-level BPE encoding and decoding by recursive queries in each partition.

A task cuts its texts into words by the vocabulary's pattern. A word that is a token
is done. The others become rows (word, position, token) of a DuckDB table in the
task, one row per byte at first; a recursive query joins neighbours with the merge
table, contracts each word's leftmost pair of minimum rank, and goes on with the
words that still have a pair. Ids are turned back by joining them with the
vocabulary and aggregating the bytes of each text in order.

Spark splits and schedules the work; there is no shuffle, and a retried task gives
the same ids. Results of words and of space-separated parts that a Python worker meets
a second time are remembered up to ``CACHE_BYTES`` each. A contraction step moves the
whole word, so the work of a word grows with the square of its length; words over
``LONG`` bytes go through a recursive query that contracts all places of a word's least
pair in one step where no pair with the new token has a lower rank, as then these places
would be contracted one after another anyway. What a query holds is
bounded: blocks of words by the sum of their squared lengths, long words by the number of
steps of one query, after which the next one goes on.

Defined results: a missing text is empty; an empty text has no ids and decodes to
nothing; equal texts have equal ids; an empty table gives an empty result. Any
UTF-8 text comes back byte for byte.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from functools import lru_cache
from hashlib import sha256
from itertools import chain, compress, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from labelaudit.llm.frames import hidden, made_of, map_texts, shown

CACHE_BYTES = 12 << 20
ENTRY_BYTES = 200  # of a remembered word besides its characters and ids
LONG = 512
BLOCK_WORDS = 10_000
BLOCK_ROWS = 2 << 20
BLOCK_BYTES = 1 << 20
DECODED_BYTES = 1 << 20
LARGE = 4  # times all of these where only digests come back, beside no other stage
#: Rows of the largest query times what a row takes, with room to spare; beyond it the query fails rather than the machine.
MEMORY_LIMIT = "600MB"

#: Rows are (spot, token, next token, rank of the two), spot = word << 10 | position. A contraction drops the row where the
#: pair starts, gives the next one its place and the new token, and looks up the two pairs that the new token is now in.
CONTRACT = """
WITH RECURSIVE steps AS (
  SELECT spot, tok, after, rank, false AS done FROM letters LEFT JOIN merges ON pair = (tok::BIGINT << 32) | after
  UNION ALL
  (WITH best AS (
     SELECT spot >> 10 AS word, min((rank::BIGINT << 32) | spot) AS least FROM steps
     WHERE rank IS NOT NULL AND NOT done GROUP BY spot >> 10),
   moved AS (
     SELECT spot, tok, after, rank, (least >> 32)::INTEGER AS new, spot - (least & 4294967295)::INTEGER AS away
     FROM steps LEFT JOIN best ON spot >> 10 = word WHERE NOT done),
   changed AS (
     SELECT CASE WHEN away > 0 THEN spot - 1 ELSE spot END AS spot, CASE WHEN away = 1 THEN new ELSE tok END AS tok,
            CASE WHEN away = -1 THEN new ELSE after END AS after, rank, away, new IS NULL AS done,
            CASE away WHEN -1 THEN (tok::BIGINT << 32) | new WHEN 1 THEN (new::BIGINT << 32) | after END AS key
     FROM moved WHERE away IS NULL OR away <> 0)
   SELECT spot, tok, after, CASE WHEN away IN (-1, 1) THEN merges.rank ELSE changed.rank END, done
   FROM changed LEFT JOIN merges ON pair = key))
SELECT spot >> 10 AS word, list(tok ORDER BY spot) AS ids FROM steps WHERE done GROUP BY spot >> 10 ORDER BY word
"""

#: The same with all places of a word's least pair in one step, if the new token is in no pair of lower rank, else the
#: leftmost; of places that overlap every second one, from the left.
CONTRACT_LONG = """
WITH RECURSIVE steps AS (
  SELECT word, pos, tok, false AS done, 0 AS step FROM letters
  UNION ALL
  (WITH pairs AS (
     SELECT word, pos, tok, step, rank, steady FROM (
       SELECT word, pos, tok, step, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS after FROM steps
       WHERE NOT done AND step < {steps})
     LEFT JOIN merges ON pair = (tok::BIGINT << 32) | after),
   marked AS (
     SELECT word, pos, tok, step, least, steady, first, coalesce(rank = least, false) AS hit
     FROM pairs JOIN (SELECT word, min(rank) AS least, arg_min(pos, (rank, pos)) AS first FROM pairs GROUP BY word) USING (word)),
   runs AS (SELECT *, pos - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS run FROM marked),
   taken AS (
     SELECT *, hit AND (steady OR pos = first) AND row_number() OVER (PARTITION BY word, hit, run ORDER BY pos) % 2 = 1 AS take
     FROM runs),
   left_ AS (SELECT *, lag(take, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone FROM taken)
   SELECT word, row_number() OVER (PARTITION BY word ORDER BY pos) - 1, CASE WHEN take THEN least ELSE tok END,
          least IS NULL, step + 1
   FROM left_ WHERE NOT gone))
SELECT word, list(tok ORDER BY pos) AS ids, bool_and(done) AS done FROM steps WHERE done OR step = {steps} GROUP BY word ORDER BY word
"""

DECODE = """
SELECT doc, list(bytes ORDER BY pos) AS pieces
FROM ids JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


class Memory:
    """What has been met a second time, up to a number of bytes; the older half goes when it is full."""

    SLOTS = 1 << 22

    def __init__(self, limit: int):
        self.limit, self.held, self.kept = limit, 0, {}
        self.met = np.zeros(self.SLOTS, bool)

    def offer(self, items: dict[str, bytes]) -> None:
        places = np.fromiter(map(hash, items), np.int64, len(items)) & (self.SLOTS - 1)
        again = dict(compress(items.items(), self.met[places].tolist()))
        self.met[places] = True
        self.kept.update(again)
        self.held += sum(map(len, again.values())) + sum(map(len, again)) + ENTRY_BYTES * len(again)
        if np.count_nonzero(self.met) > self.SLOTS // 2:
            self.met[:] = False
        while self.held > self.limit:
            self.kept = dict(islice(self.kept.items(), (len(self.kept) + 1) // 2, None))
            self.held = sum(ENTRY_BYTES + len(k) + len(v) for k, v in self.kept.items())


class Codec:
    """Encodes and decodes lists of texts; packed ids are little-endian 32-bit numbers."""

    def __init__(self, path: str, pattern: str, times: int = 1):
        import duckdb
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.words = regex.compile(pattern).findall
        self.tokens = {t.decode(): self._packed([r]) for t, r in self.ranks.items() if _is_text(t)}
        self.known, self.parts, self.times = Memory(CACHE_BYTES * times), Memory(CACHE_BYTES * times), times
        self.letters = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect()
        for setting in ("threads = 1", "temp_directory = ''", "enable_progress_bar = false", f"memory_limit = '{MEMORY_LIMIT}'"):
            self.db.execute(f"SET {setting}")
        merges = [
            (self.ranks[t[:i]], self.ranks[t[i:]], r)
            for t, r in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        low: dict[int, int] = {}  # the least rank of the pairs that a token is in
        for a, b, r in merges:
            low[a], low[b] = min(low.get(a, r), r), min(low.get(b, r), r)
        pairs = np.array(merges, np.int64).reshape(-1, 3)
        steady = [low.get(r, r + 1) > r for r in pairs[:, 2].tolist()]
        self._table("merges", pair=pairs[:, 0] << 32 | pairs[:, 1], rank=pairs[:, 2].astype(np.int32), steady=steady)
        self._table("vocabulary", id=np.array(list(self.ranks.values()), np.int32), bytes=list(self.ranks))

    @staticmethod
    def _packed(ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _rows(self, query: str) -> pa.Table:
        return self.db.sql(query).to_arrow_table().combine_chunks()

    def _contract(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of words that are no tokens."""
        out: dict[str, bytes] = {}
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        short = np.flatnonzero(length <= LONG)
        rows, most = BLOCK_ROWS * self.times, BLOCK_WORDS * self.times
        part = np.maximum(np.cumsum(length[short] ** 2) // rows, np.arange(len(short)) // most)
        for block in np.split(short, np.flatnonzero(np.diff(part)) + 1) if len(short) else []:
            sizes = length[block]
            word = np.repeat(np.arange(len(block)), sizes)
            pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            letters = self.letters[np.frombuffer(b"".join([raw[i] for i in block]), np.uint8)]
            after = np.append(letters[1:], -1).astype(np.int32)
            after[np.cumsum(sizes) - 1] = -1  # nothing follows the last one
            self._table("letters", spot=(word << 10 | pos).astype(np.int32), tok=letters, after=after)
            ids = self._rows(CONTRACT).column("ids").chunk(0)
            whole, cuts = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
            out.update((words[i], whole[a:b]) for i, a, b in zip(block.tolist(), cuts[:-1], cuts[1:]))
        if len(short) < len(words):
            out.update((w, self._contract_long(w)) for w in words if w not in out)
        return out

    def _contract_long(self, word: str) -> bytes:
        ids, done = self.letters[np.frombuffer(word.encode(), np.uint8)], False
        while not done:
            self._table("letters", word=np.zeros(len(ids), np.int32), pos=np.arange(len(ids), dtype=np.int64), tok=ids)
            rows = self._rows(CONTRACT_LONG.format(steps=max(1, BLOCK_ROWS // len(ids))))
            ids, done = rows.column("ids").chunk(0).values.to_numpy(), rows.column("done")[0].as_py()
        return self._packed(ids)

    def _ids(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of each word."""
        tokens, known = self.tokens, self.known.kept
        out = {w: i for w in words if (i := tokens.get(w) or known.get(w))}
        new = self._contract([w for w in words if w not in out])
        self.known.offer(new)
        out.update(new)
        return out

    def _encode_block(self, texts: list[str]) -> list[bytes]:
        # A single space between two other characters starts a new word under the pattern,
        # whatever stands around it, so the parts between such spaces can be looked up whole.
        cut = [t.split(" ") for t in texts]
        number: dict[str, int] = defaultdict(count().__next__)
        codes = [list(map(number.__getitem__, own)) for own in cut]
        parts = list(number)
        made = list(map(self.parts.kept.get, parts))
        new = [i for i, ids in enumerate(made) if ids is None]
        odd = {i for i in new if not (p := parts[i]) or p[0].isspace() or p[-1].isspace()}
        fresh = [i for i in new if i not in odd]
        # one text of all new parts; its words that start with a space start a part
        words = self.words(" " + " ".join([parts[i] for i in fresh])) if fresh else []
        plain, whole = {}, {}  # the first part of a text has no space before it
        for i, own in enumerate(codes):
            if odd and not odd.isdisjoint(own):
                whole[i] = self.words(texts[i])
            else:
                plain[i] = self.words(cut[i][0])
        ids = self._ids({*words, *chain.from_iterable(plain.values()), *chain.from_iterable(whole.values())})
        found = ids.__getitem__
        starts = [i for i, w in enumerate(words) if w[0] == " "]
        coded = list(map(found, words))
        for i, a, b in zip(fresh, starts, [*starts[1:], len(words)]):
            made[i] = coded[a] if b - a == 1 else b"".join(coded[a:b])
        of = made.__getitem__
        out = [
            b"".join(map(found, whole[i])) if i in whole else b"".join([*map(found, plain[i]), *map(of, own[1:])])
            for i, own in enumerate(codes)
        ]
        self.parts.offer({parts[i]: made[i] for i in fresh})
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each UTF-8 text."""
        out: list[bytes] = []
        for block in _blocks(texts, BLOCK_BYTES * self.times):
            out += self._encode_block([t.decode() for t in block])
        return out

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes that packed ids stand for."""
        out: list[bytes] = []
        for block in _blocks(packed, DECODED_BYTES * self.times):
            sizes = np.array([len(p) // 4 for p in block])
            ids = np.frombuffer(b"".join(block), "<u4").astype(np.int32)
            doc = np.repeat(np.arange(len(block), dtype=np.int32), sizes)
            given = pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int32), "id": ids})
            self.db.register("ids", given)
            rows = self._rows(DECODE)
            self.db.unregister("ids")
            texts = [b""] * len(block)
            if rows.num_rows:
                pieces = rows.column("pieces").chunk(0)
                ends = np.frombuffer(pieces.values.buffers()[1], np.int32 if pa.types.is_binary(pieces.values.type) else np.int64)
                data = pieces.values.buffers()[2]
                cuts = ends[pieces.offsets.to_numpy() + pieces.values.offset].tolist()
                for i, a, b in zip(rows.column("doc").to_pylist(), cuts[:-1], cuts[1:]):
                    texts[i] = data[a:b].to_pybytes()
            out += texts
        return out


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def _blocks(items: list[bytes], size: int):
    """Runs of ``items`` of about ``size`` bytes; a longer item is a run of its own."""
    block, n = [], 0
    for item in items:
        if block and n + len(item) > size:
            yield block
            block, n = [], 0
        block.append(item)
        n += len(item)
    if block:
        yield block


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, times: int = 1) -> Codec:
    """One per Python worker and vocabulary."""
    return Codec(path, pattern, times)


def production() -> tuple[str, str]:
    """Path of the rank file, the same on all machines, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """All columns of ``docs``, and the token ids of each text."""
    given = vocabulary or production()
    rows, names = hidden(docs)

    def run(texts: list[bytes]) -> dict[str, list]:
        return {"ids": [np.frombuffer(p, "<u4").astype(np.int32) for p in codec(*given).encode(texts)]}

    made = rows.withColumn("made", made_of(F.col(names[text]), "ids array<int>", run))
    return shown(made, names, made["made.ids"].alias(ids))


def decode(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """All columns of ``encoded``, and the bytes its ids stand for."""
    given = vocabulary or production()
    rows, names = hidden(encoded)
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(names[ids]).to_pylist()
            packed = [Codec._packed(x if x is not None else []) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(codec(*given).decode(packed), pa.binary())], names=schema.names
            )

    made = rows.mapInArrow(run, schema)
    return shown(made, names, made["decoded"].alias(decoded))


def encode_checked(
    docs: DataFrame, text: str = "text", ids: str = "ids", same: str = "round_trip", vocabulary: tuple[str, str] | None = None
) -> DataFrame:
    """All columns of ``docs``, the token ids of each text, and whether they decode to it."""
    given = vocabulary or production()
    rows, names = hidden(docs)

    def run(texts: list[bytes]) -> dict[str, list]:
        packed = codec(*given).encode(texts)
        back = codec(*given).decode(packed)
        return {"ids": [np.frombuffer(p, "<u4").astype(np.int32) for p in packed], "same": list(map(bytes.__eq__, texts, back))}

    made = rows.withColumn("made", made_of(F.col(names[text]), "ids array<int>, same boolean", run))
    return shown(made, names, made["made.ids"].alias(ids), made["made.same"].alias(same))


def digests(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``keep`` columns, n_tokens, and digests of the ids and of what they decode to.

    Encodes and decodes in one pass over the texts, and returns neither.
    """
    given = vocabulary or production()

    def run(texts: list[bytes]) -> dict[str, list]:
        packed = codec(*given, LARGE).encode(texts)
        return {
            "n_tokens": [len(p) // 4 for p in packed],
            "ids_sha256": [sha256(p).hexdigest() for p in packed],
            "decoded_sha256": [sha256(t).hexdigest() for t in codec(*given, LARGE).decode(packed)],
        }

    return map_texts(docs, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", run, BLOCK_BYTES * LARGE)
