"""Counts over event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from labelaudit.functions.expressions import month_of
from labelaudit.operators.profile import top_k


def monthly_counts(df: DataFrame, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per month and group; rows missing either are left out."""
    return (
        df.select(month_of(ts).alias("month"), *by)
        .dropna()
        .groupBy("month", *by)
        .agg(F.count("*").alias("n"))
    )


def smooth(counts: DataFrame, by: Sequence[str], order: str, width: int) -> DataFrame:
    """Centred moving mean over rows, shorter at both ends.

    An even width takes one row more before than after. Runs on the aggregated
    series, one row per month and group.
    """
    before = width // 2
    frame = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(order)
        .rowsBetween(-before, width - 1 - before)
    )
    return counts.withColumn("smoothed", F.avg("n").over(frame))


def yearly_trend(df: DataFrame, category: str, ts: str, k: int) -> DataFrame:
    """Rows per year for the k most frequent categories.

    Years without rows between a category's first and last year count 0.
    """
    top = top_k(df, category, k).select(category)
    counts = (
        df.select(category, F.year(ts).alias("year"))
        .dropna()
        .join(F.broadcast(top), category, "left_semi")
        .groupBy(category, "year")
        .agg(F.count("*").alias("n"))
    )
    years = counts.groupBy(category).agg(F.min("year").alias("_a"), F.max("year").alias("_z"))
    calendar = years.select(category, F.explode(F.sequence("_a", "_z")).alias("year"))
    return calendar.join(counts, [category, "year"], "left").na.fill(0, ["n"])
