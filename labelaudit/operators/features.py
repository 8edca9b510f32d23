"""Tokens, fixed-length encodings and document vectors."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from labelaudit.functions.expressions import text_or_empty
from labelaudit.operators.ordering import ranked
from labelaudit.session import store

PAD, UNKNOWN, FIRST_ID = 0, 1, 2
POOL = 1 << 26  # numbers of the vectors that are sent to the texts
PIECE = 1 << 22  # of which the driver and a task hold so many at once
WORDS = 1 << 19  # tokens that a task meets them with
BLOCK = 1 << 23  # numbers of the vectors that a task holds otherwise
TEAM = 1 << 21  # counts that it meets them with
_SOME = 1 << 15  # of which so many are multiplied at once


def tokens(text: Column | str) -> Column:
    """Lower-cased text split at spaces and line breaks; missing text has no tokens."""
    return F.filter(F.split(F.lower(text_or_empty(text)), "[ \n]+"), lambda t: t != "")


def build_vocab(df: DataFrame, text: str, max_size: int) -> DataFrame:
    """(token, token_id, n) of the most frequent tokens of the whole corpus.

    Ties go by token; ids follow the order. How many tokens there are of each count says
    which count is enough; only tokens of at least that count are ranked, in slices, so
    neither they nor the vocabulary pass through one task. The vocabulary is written, so
    that joins with it know its size and broadcast it only if it is small.
    """
    if max_size < 1:
        raise ValueError("max_size must be at least 1")
    words = df.select(F.explode(tokens(text)).alias("token"))
    counts = store(words.groupBy("token").agg(F.count("*").alias("n")), "token-counts")
    # the largest counts: a row each, and no more of them than the vocabulary has places
    most = counts.groupBy("n").agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).limit(max_size).collect()
    enough, places = 1, 0
    for row in most:
        enough, places = row["n"], places + row["tokens"]
        if places >= max_size:
            break
    placed = ranked(counts.where(F.col("n") >= enough), [], [F.desc("n"), F.asc("token")]).where(F.col("rank") <= max_size)
    vocab = placed.select("token", (F.col("rank") + F.lit(FIRST_ID - 1)).cast("int").alias("token_id"), "n")
    return store(vocab, "vocabulary")


def encode(
    df: DataFrame, text: str, vocab: DataFrame, max_len: int = 512, row_id: str = "row_id"
) -> DataFrame:
    """(row_id, ids, mask, n_tokens): ids cut and padded to ``max_len``.

    Texts are cut before they are taken apart, and a text's entries are packed
    before they move: one row per text is shuffled where the vocabulary is small
    enough to be broadcast. ``n_tokens`` counts the whole text.
    """
    words = df.select(row_id, tokens(text).alias("_t"))
    parts = words.select(
        row_id,
        F.size("_t").alias("n_tokens"),
        F.posexplode_outer(F.slice("_t", 1, max_len)).alias("_pos", "token"),
    )
    ids = vocab.select("token", "token_id")
    looked_up = parts.join(ids, "token", "left")
    # place and id in one number, which sorts by place
    entry = F.when(
        F.col("_pos").isNotNull(),
        F.shiftleft(F.col("_pos").cast("bigint"), 32).bitwiseOR(F.coalesce("token_id", F.lit(UNKNOWN)).cast("bigint")),
    )
    packed = looked_up.groupBy(row_id, "n_tokens").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    found = F.transform("_e", lambda e: e.bitwiseAND(F.lit((1 << 32) - 1).cast("bigint")).cast("int"))
    missing = F.lit(max_len) - F.size("_e")
    return packed.select(
        row_id,
        F.concat(found, F.array_repeat(F.lit(PAD), missing)).alias("ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_e")), F.array_repeat(F.lit(0), missing)).alias("mask"),
        "n_tokens",
    )


def mean_pool(
    df: DataFrame,
    text: str,
    vectors: DataFrame,
    dim: int,
    max_len: int | None = None,
    row_id: str = "row_id",
    key: Callable[[Column], Column] = lambda token: token,
) -> DataFrame:
    """(row_id, vector): mean of the vectors of a text's tokens, a row for every text.

    ``vectors`` is (token, v) with ``dim`` numbers each; with ``key``, its tokens are
    what ``key`` makes of a text's tokens. Tokens without a vector are left out of the
    mean, and the vector of a text with none is missing. Up to ``POOL`` numbers are sent to
    the texts, some at a time, so that neither texts nor tokens move, and a text has one sum;
    more vectors are dealt into blocks, to which a text sends its counts, and of which it
    gets one sum each. Vectors with missing numbers, which count where they are there, are
    joined to the counts in any case. ``max_len`` cuts texts to their first tokens, as an encoder would; by default the whole text counts.
    """
    words = tokens(text)
    if max_len is not None:
        words = F.slice(words, 1, max_len)
    table = vectors.select(F.col("token").alias("_key"), "v").where(F.col("v").isNotNull())
    odd = (F.size("v") < dim) | F.exists(F.slice("v", 1, dim), lambda x: x.isNull())
    size = table.agg(F.count("*").alias("n"), F.count_if(odd).alias("odd")).first()
    few, kinds = size["n"] * dim <= POOL and not size["odd"], (T.LongType, T.IntegerType, T.StringType)
    each = df.select(row_id, F.explode_outer(words).alias("_token")).select(row_id, key(F.col("_token")).alias("_key"))
    kind = table.schema["_key"].dataType
    if few and kind == each.schema["_key"].dataType and isinstance(kind, kinds):
        return _pooled_in_place(each, table, dim, row_id, max(1, math.ceil(size["n"] * dim / PIECE)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(row_id, text).repartition(n, row_id)  # the one shuffle: counts and sums stay where a text is
    parts = texts.select(row_id, F.explode_outer(words).alias("_token")).withColumn("_key", key(F.col("_token")))
    parts = parts.groupBy(row_id, "_key").agg(F.count("_token").alias("_c"))
    if size["n"] * dim > POOL and not size["odd"]:
        return _pooled_in_blocks(parts, table, dim, row_id, math.ceil(size["n"] * dim / BLOCK))
    sums = parts.join(table, "_key", "left").groupBy(row_id).agg(
        F.sum(F.when(F.col("v").isNotNull(), F.col("_c")).otherwise(0)).alias("_n"),
        *[F.sum(F.col("v")[i].cast("double") * F.col("_c")).alias(f"_{i}") for i in range(dim)],
    )
    mean = F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(dim)])
    return sums.select(row_id, F.when(F.col("_n") > 0, mean).alias("vector"))


def _piece(rows: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, the sum of each one's vectors, and how many these are."""
    code, names = pd.factorize(rows["_key"].to_pandas(), sort=True)
    v = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    if len(names) == len(code):
        out = np.empty_like(v)
        out[code] = v
    else:  # a token with several vectors
        out = np.zeros((len(names), dim))
        np.add.at(out, code, v)
    return np.asarray(names), out, np.bincount(code, minlength=len(names))


def _places(names: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where the keys are in ``names``, which ascend; -1 for none."""
    if not len(names) or not len(keys):
        return np.full(len(keys), -1)
    if names.dtype == object:
        return pd.Index(names).get_indexer(keys)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, at, -1)


def _pooled_in_place(each: DataFrame, table: DataFrame, dim: int, row_id: str, n_pieces: int) -> DataFrame:
    """:func:`mean_pool` of tokens (row_id, _key), those of a text in a row: the vectors come to them."""
    context = each.sparkSession.sparkContext
    given = table.schema["v"].dataType.elementType
    number = given if isinstance(given, (T.FloatType, T.DoubleType)) else T.DoubleType()
    v = F.transform(F.slice("v", 1, dim), lambda x: x.cast(number)).alias("v")
    own = F.pmod(F.xxhash64("_key"), F.lit(n_pieces))
    rows = table.where(F.col("_key").isNotNull())
    # every piece is a bounded table on the driver, one after the other
    pieces = [context.broadcast(_piece(rows.where(own == i).select("_key", v).toArrow(), dim)) for i in range(n_pieces)]

    def summed(rows: pa.Table) -> pa.RecordBatch:
        runs = pc.run_end_encode(rows[row_id].combine_chunks())
        ends = runs.run_ends.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        keys = rows["_key"].combine_chunks()
        there = keys.is_valid().to_numpy(zero_copy_only=False)
        text, keys = text[there], keys.drop_null().to_numpy(zero_copy_only=False)
        sums, n = np.zeros((len(ends), dim)), np.zeros(len(ends), np.int64)
        for piece in pieces:
            names, vectors, times = piece.value
            if n_pieces > 1:
                vars(piece).pop("_value", None)  # one piece at a time
            place = _places(names, keys)
            row, place = text[place >= 0], place[place >= 0]
            n += np.bincount(row, times[place], len(n)).astype(np.int64)
            for at in range(0, len(row), _SOME):
                some = slice(at, at + _SOME)
                first = np.flatnonzero(np.diff(row[some], prepend=-1))
                sums[row[some][first]] += np.add.reduceat(vectors[place[some]].astype(np.float64), first)
        cuts = pa.array(np.arange(0, (len(ends) + 1) * dim, dim, dtype=np.int32))
        lists = pa.ListArray.from_arrays(cuts, pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([runs.values, pa.array(n), lists], names=[row_id, "_n", "_s"])

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if held and (batch is None or size >= WORDS):
                yield summed(pa.Table.from_batches(held))
                held, size = [], 0

    kind = each.schema[row_id].dataType.simpleString()
    found = each.mapInArrow(pool, f"`{row_id}` {kind}, _n bigint, _s array<double>")
    # a row per text, and where a text was cut or its id comes again, one more
    sums = found.groupBy(row_id).agg(F.sum("_n").alias("_n"), *[F.sum(F.get("_s", F.lit(i))).alias(f"_{i}") for i in range(dim)])
    mean = F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(dim)])
    return sums.select(row_id, F.when(F.col("_n") > 0, mean).alias("vector"))


def _pooled_in_blocks(parts: DataFrame, table: DataFrame, dim: int, row_id: str, n_blocks: int) -> DataFrame:
    """:func:`mean_pool` of counted tokens (row_id, _key, _c) where no task holds all vectors."""
    block = F.pmod(F.xxhash64("_key"), F.lit(n_blocks)).cast("int").alias("_b")
    entry = F.when(F.col("_key").isNotNull(), F.struct("_key", "_c"))
    lists = parts.groupBy(row_id, block).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    counts = store(lists.select(row_id, "_b", F.col("_e._key").alias("_keys"), F.col("_e._c").alias("_counts")), "text-counts")
    entries = counts.agg(F.coalesce(F.sum(F.size("_keys")), F.lit(0))).first()[0]
    teams = max(1, math.ceil(entries / n_blocks / TEAM))
    guests = counts.where(F.size("_keys") > 0).withColumn("_t", F.pmod(F.xxhash64(row_id), F.lit(teams)).cast("int"))
    numbers = F.transform(F.slice("v", 1, dim), lambda x: x.cast("double")).alias("v")
    hosts = table.where(F.col("_key").isNotNull()).select(block, "_key", numbers)
    hosts = hosts.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))))

    def pool(guest: pa.Table, host: pa.Table) -> pa.Table:
        """Sum of the block's vectors, times their counts, for each text that has any."""
        code, names = pd.factorize(host["_key"].to_pandas())
        v = host["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        times = np.bincount(code, minlength=len(names))
        if len(names) < len(code):  # a token with several vectors
            each, v = v, np.zeros((len(names), dim))
            np.add.at(v, code, each)
        keys = guest["_keys"].combine_chunks()
        row = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
        place = pd.Index(names).get_indexer(keys.flatten().to_pandas()) if len(names) else np.full(len(row), -1)
        hit = place >= 0
        c = guest["_counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)[hit]
        row, place = row[hit], place[hit]
        met, starts = np.unique(row, return_index=True)
        sums = np.zeros((len(met), dim))
        nth = np.searchsorted(met, row)
        for at in range(0, len(row), _SOME):
            some = slice(at, at + _SOME)
            first = np.flatnonzero(np.diff(nth[some], prepend=-1))
            sums[nth[some][first]] += np.add.reduceat(v[place[some]] * c[some, None], first)
        n = np.add.reduceat(c * times[place], starts) if len(met) else np.empty(0, np.int64)
        ends = pa.array(np.arange(0, (len(met) + 1) * dim, dim, dtype=np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))
        return pa.table({row_id: guest[row_id].take(pa.array(met)), "_n": pa.array(n, pa.int64()), "_s": lists})

    kind = counts.schema[row_id].dataType.simpleString()
    found = guests.groupBy("_b", "_t").cogroup(hosts.groupBy("_b", "_t")).applyInArrow(
        pool, f"`{row_id}` {kind}, _n bigint, _s array<double>"
    )
    every = counts.select(row_id, F.lit(0).cast("bigint").alias("_n"), F.lit(None).cast("array<double>").alias("_s"))
    sums = found.union(every).groupBy(row_id).agg(
        F.sum("_n").alias("_n"), *[F.sum(F.get("_s", F.lit(i))).alias(f"_{i}") for i in range(dim)]
    )
    mean = F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(dim)])
    return sums.select(row_id, F.when(F.col("_n") > 0, mean).alias("vector"))


def tf_idf(df: DataFrame, text: str, vocab: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, token, weight): counts of vocabulary tokens times ln((rows + 1) / (rows with the token + 1)).

    Other tokens go before anything is counted, and the counts are written once for
    both their uses.
    """
    words = df.select(row_id, F.explode(tokens(text)).alias("token")).join(vocab.select("token"), "token")
    counts = store(words.groupBy(row_id, "token").agg(F.count("*").alias("_n")), "term-counts")
    total = df.agg(F.count("*")).first()[0]
    idf = store(counts.groupBy("token").agg(F.log((F.lit(total) + 1) / (F.count("*") + 1)).alias("_w")), "token-weights")
    return counts.join(idf, "token").select(row_id, "token", (F.col("_n") * F.col("_w")).alias("weight"))


def fit_text_features(df: DataFrame, text: str, size: int = 1 << 16) -> PipelineModel:
    """Hashed, idf-weighted, length-normalized token features (column ``features``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer

    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern="[ \n]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="features", p=2.0),
    ]
    return Pipeline(stages=stages).fit(df.withColumn(text, text_or_empty(text)))


def text_features(df: DataFrame, model: PipelineModel, text: str) -> DataFrame:
    ready = df.withColumn(text, text_or_empty(text))
    return model.transform(ready).drop("_words", "_tf", "_idf")


def fit_word_vectors(df: DataFrame, text: str, dim: int = 64, seed: int = 42, min_count: int = 5):
    """Train token vectors on the corpus; returns (token, v) for :func:`mean_pool`."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = df.select(tokens(text).alias("_w"))
    model = Word2Vec(vectorSize=dim, seed=seed, minCount=min_count, inputCol="_w", outputCol="_o").fit(words)
    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("v"))
