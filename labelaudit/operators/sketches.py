"""Sketches that are kept and merged: distinct counts and quantiles of any range of days.

A sketch is a small table, a row per register or bucket, so it is stored, filtered and
merged with plain aggregates: the sketch of several parts is the maximum (distinct) or the
sum (quantiles) of theirs, and equals the sketch of all rows, whatever the parts.

Distinct values: values fall by their hash on ``2**bits`` registers, which keep the longest
run of leading zeros seen. The standard error of the estimate is 1.04 / sqrt(2**bits), 1.6 %
with 12 bits. Quantiles: values are counted in buckets whose bounds grow by a constant factor,
so that every value of a bucket is within ``accuracy`` of its middle, relatively.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from labelaudit.operators.ordering import running_totals

BITS = 12
ACCURACY = 0.01
_REST = 52  # bits of the hash after those of the register


def distinct_sketch(df: DataFrame, column: str, by: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """(by, register, zeros): at most ``2**bits`` rows a group. Missing values are left out."""
    if not 4 <= bits <= 16 or bits % 4:
        raise ValueError("bits is 4, 8, 12 or 16")
    h = F.md5(F.col(column).cast("string"))
    digits = bits // 4
    rest = F.conv(F.substring(h, digits + 1, _REST // 4), 16, 10).cast("bigint")
    zeros = F.when(rest == 0, _REST + 1).otherwise(_REST + 1 - F.length(F.bin(rest)))
    seen = df.where(F.col(column).isNotNull())
    placed = seen.select(*by, F.conv(F.substring(h, 1, digits), 16, 10).cast("int").alias("register"), zeros.alias("_z"))
    return placed.groupBy(*by, "register").agg(F.max("_z").cast("int").alias("zeros"))


def merged_distinct(sketch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketch of coarser groups, all rows of ``sketch`` in each."""
    return sketch.groupBy(*by, "register").agg(F.max("zeros").alias("zeros"))


def distinct_estimate(sketch: DataFrame, by: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """(by, n): the estimated number of distinct values of each group."""
    m = 1 << bits
    alpha = 0.7213 / (1 + 1.079 / m) if m >= 128 else {16: 0.673, 32: 0.697, 64: 0.709}[m]
    merged = merged_distinct(sketch, by)
    used = F.count("*")
    # an empty register counts 1
    raw = F.lit(alpha * m * m) / (F.sum(F.pow(F.lit(2.0), -F.col("zeros"))) + (m - used))
    few = F.lit(float(m)) * F.log(F.lit(float(m)) / F.greatest(m - used, F.lit(1)))
    return merged.groupBy(*by).agg(F.when((raw <= 2.5 * m) & (used < m), few).otherwise(raw).alias("n"))


def _bucket(value: Column, accuracy: float) -> Column:
    step = math.log((1 + accuracy) / (1 - accuracy))
    return F.ceil(F.log(F.abs(value)) / F.lit(step)).cast("int")


def quantile_sketch(df: DataFrame, value: str, by: Sequence[str] = (), accuracy: float = ACCURACY) -> DataFrame:
    """(by, side, bucket, n): counts of values below, at and above zero by the size of the value. Missing values, NaN and infinities are left out."""
    v = F.col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    side = F.signum(v).cast("int")
    placed = df.where(usable).select(*by, side.alias("side"), F.when(v == 0, 0).otherwise(_bucket(v, accuracy)).alias("bucket"))
    return placed.groupBy(*by, "side", "bucket").agg(F.count("*").alias("n"))


def merged_quantiles(sketch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sketch.groupBy(*by, "side", "bucket").agg(F.sum("n").alias("n"))


def quantile_estimate(
    sketch: DataFrame, probs: Sequence[float], by: Sequence[str] = (), accuracy: float = ACCURACY
) -> DataFrame:
    """(by, prob, value): the middle of the bucket that holds the value at ``ceil(prob * n)`` (the first at 0)."""
    gamma = (1 + accuracy) / (1 - accuracy)
    merged = merged_quantiles(sketch, by).withColumn("_o", F.col("side") * F.col("bucket"))
    # a bucket of small numbers may have the same product on both sides of zero, but never the same side
    placed = running_totals(merged, list(by), ["side", "_o"], {"_n": F.col("n")})
    middle = F.col("side") * F.lit(2 / (gamma + 1)) * F.pow(F.lit(gamma), F.col("bucket"))
    picks = []
    for q in probs:
        at = F.greatest(F.ceil(F.lit(float(q)) * F.col("_n_total")), F.lit(1))
        here = (F.col("_n_upto") >= at) & (F.col("_n_upto") - F.col("n") < at)
        picks.append(F.max(F.when(here, middle)))
    rows = [F.struct(F.lit(float(q)).alias("prob"), F.col(f"_q{i}").alias("value")) for i, q in enumerate(probs)]
    return placed.groupBy(*by).agg(*[p.alias(f"_q{i}") for i, p in enumerate(picks)]).select(*by, F.inline(F.array(*rows)))
