"""Cleaning, assembling and exact deduplication of corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelaudit.functions.expressions import default_label, text_key
from labelaudit.sources.schemas import require_columns

SALTS = 64  # slices of a key at most
SLICE = 2048  # rows of a key that are not dealt out


def by_value(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter; on a stored column it reaches the Parquet scan."""
    return df.where(F.col(column) == value)


def drop_missing(df: DataFrame, must: Sequence[str], if_present: Sequence[str] = ()) -> DataFrame:
    """Drop rows missing a value in ``must``, or in those of ``if_present`` that exist."""
    require_columns(df, must)
    return df.dropna(subset=[*must, *[c for c in if_present if c in df.columns]])


def assemble(*frames: DataFrame) -> DataFrame:
    """Stack tables by column name; columns a table lacks become missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _key(df: DataFrame, keys: Sequence[str]) -> Column:
    """Fixed-width grouping key, so that long texts are not shuffled to compare them."""
    if len(keys) == 1 and df.schema[keys[0]].dataType.typeName() == "string":
        return text_key(keys[0])
    return F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)


def _complete(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def salted_join(
    left: DataFrame, right: DataFrame, key: str, salt_by: str, how: str = "inner", key_r: str | None = None, salts: int = SALTS
) -> DataFrame:
    """Join on a key that may hold a large part of ``left``, missing keys being equal.

    ``right`` has one row per key, in its column ``key_r`` (``key`` by default). Keys with
    more than ``SLICE`` rows in ``left``, which are counted first, are dealt into slices of
    about as many rows, ``salts`` at most: ``right`` is repeated for each slice of such a key
    and of no other, and every left row meets the slice that the hash of ``salt_by`` names, so
    no key is one task. Pass narrow rows on both sides; ``left`` is read twice.
    """
    slices = F.least(F.ceil(F.count("*") / F.lit(SLICE)).cast("int"), F.lit(salts))
    # a row per key of many rows: at most one for every SLICE rows of left
    own, theirs = F.struct(F.col(key).alias("k")), F.struct(F.col("_key_r").alias("k"))
    heavy = F.broadcast(left.groupBy(own.alias("_heavy")).agg(slices.alias("_slices")).where("_slices > 1"))
    n = F.coalesce("_slices", F.lit(1))
    many = right.withColumnRenamed(key_r or key, "_key_r")
    many = many.join(heavy, theirs.eqNullSafe(F.col("_heavy")), "left")
    many = many.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), n - 1))).drop("_heavy", "_slices")
    one = left.join(heavy, own.eqNullSafe(F.col("_heavy")), "left")
    one = one.withColumn("_salt_l", F.pmod(F.xxhash64(salt_by), n).cast("int")).drop("_heavy", "_slices")
    same = F.col(key).eqNullSafe(F.col("_key_r")) & (F.col("_salt_l") == F.col("_salt_r"))
    return one.join(many, same, how).drop("_key_r", "_salt_l", "_salt_r")


def dedupe(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """Keep the row with the smallest ``row_id`` for each key; rows without a key go.

    Groups are found on (hash, row_id) alone, with partial aggregation, so a text
    held by a third of all rows is one row per map task. The wide table meets the ids
    to keep, which are unique.
    """
    full = _complete(df, keys)
    narrow = full.select(F.col(row_id), _key(df, keys).alias("_k"))
    first = narrow.groupBy("_k").agg(F.min(row_id).alias(row_id)).select(row_id)
    return full.join(first, row_id, "left_semi")


def duplicate_members(df: DataFrame, keys: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Every row whose key occurs more than once. ``row_id`` is unique."""
    narrow = _complete(df, keys).select(row_id, _key(df, keys).alias("_k"))
    repeated = narrow.groupBy("_k").agg(F.count("*").alias("_n")).where("_n > 1").select("_k")
    return df.join(salted_join(narrow, repeated, "_k", row_id).select(row_id), row_id, "left_semi")


def dedupe_report(df: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows before and after deduplication, with the number removed."""
    keyed = _complete(df, keys).select(*by, _key(df, keys).alias("_k"))
    per_key = keyed.groupBy(*by, "_k").agg(F.count("*").alias("_n"))
    return per_key.groupBy(*by).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_before"),
        F.count("*").alias("n_after"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def assemble_and_dedupe(
    frames: Sequence[DataFrame], content: str = "content", label: str = "label", value: int = 1
) -> DataFrame:
    """Stack sources, default the label, and keep one row per content.

    Copies across sources are removed too: an earlier source wins, then the
    smaller ``row_id``. Adds ``source_no``; the pair is unique.
    """
    numbered = [f.withColumn("source_no", F.lit(i)) for i, f in enumerate(frames)]
    stacked = assemble(*numbered)
    stacked = stacked.withColumn(label, default_label(label, value))
    ordered = stacked.withColumn("_place", F.struct("source_no", "row_id"))
    return dedupe(ordered, [content], "_place").drop("_place")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts (missing keys included)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not repeated_keys(df, keys).isEmpty():
        raise ValueError(f"rows are not unique by {list(keys)}")
    return df


def exclude(
    df: DataFrame, other: DataFrame, key: str, other_key: str | None = None, row_id: str | None = None
) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other``.

    A missing key in ``df`` is dropped with the others only when ``other`` holds
    a missing key, as set membership treats them as equal. With ``row_id``, a unique
    column, keys are compared on narrow rows and the wide ones meet ids alone;
    without it, the wide rows are shuffled by key and a hash of the row.
    """
    kind = df.schema[key].dataType.typeName()
    wrap = text_key if kind == "string" else F.col
    keys = other.select(wrap(other_key or key).alias("_k")).distinct()
    if row_id is not None:
        gone = salted_join(df.select(row_id, wrap(key).alias("_k")), keys, "_k", row_id)
        return df.join(gone.select(row_id), row_id, "left_anti")
    left = df.select("*", wrap(key).alias("_k"), F.xxhash64(*df.columns).alias("_row"))
    return salted_join(left, keys, "_k", "_row", "left_anti").drop("_k", "_row")
