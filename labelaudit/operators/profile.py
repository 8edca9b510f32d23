"""Counts, shares, summaries and crosstabs. NULL is never a category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelaudit.operators.ordering import exact_quantiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, ties by value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc(column))
    )


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Counts with their share of all non-missing values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = df.agg(F.count(column).alias("total")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def group_shares(df: DataFrame, by: str, column: str) -> DataFrame:
    """Share of each value within its group, as printed on count plots."""
    counts = (
        df.where(F.col(by).isNotNull() & F.col(column).isNotNull())
        .groupBy(by, column)
        .agg(F.count("*").alias("n"))
    )
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    return value_counts(df, column).limit(k)


def top_k_by(df: DataFrame, by: str, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of each group, numbered from 1."""
    counts = (
        df.where(F.col(by).isNotNull() & F.col(column).isNotNull())
        .groupBy(by, column)
        .agg(F.count("*").alias("n"))
    )
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), F.asc(column)))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def distinct_profile(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct values per column, one row each."""
    count = F.approx_count_distinct if approx else F.count_distinct
    one = df.agg(*[count(F.col(c)).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_distinct")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def extent(df: DataFrame, date: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def positive_rate(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(label).alias("positive_rate"))


def null_profile(df: DataFrame) -> DataFrame:
    """Type and number of present values for each column, from one pass."""
    one = df.agg(
        F.count("*").alias("__rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col("__rows").alias("n_rows"),
            F.col(f"`{f.name}`").alias("n_present"),
        )
        for f in df.schema
    ]
    return one.select(F.inline(F.array(*rows)))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]
    valued = df.select(F.inline(F.array(*rows)))
    return valued.where(F.col("value").isNotNull() & ~F.isnan("value"))


def describe(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Count, mean, sample sd, min, quartiles and max per column.

    Quartiles are exact and interpolated; ``approx`` answers them in the same pass.
    """
    long = _long(df, columns)
    basics = [
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    names = ["q25", "q50", "q75"]
    if approx:
        q = F.percentile_approx("value", [0.25, 0.5, 0.75], 10000)
        out = long.groupBy("column_name").agg(*basics, q.alias("_q"))
        return out.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)]).drop("_q")
    quartiles = (
        exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["column_name"])
        .groupBy("column_name")
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
               for p, n in zip([0.25, 0.5, 0.75], names)])
    )
    return long.groupBy("column_name").agg(*basics).join(quartiles, "column_name")


def crosstab_topk(
    df: DataFrame,
    row: str,
    col: str,
    k: int,
    k_col: int | None = None,
    row_filter: Column | None = None,
    col_filter: Column | None = None,
) -> DataFrame:
    """Counts of (row, col) pairs with both values in their top-k lists, long form.

    Each list may come from a filtered part of the table; the counts use all
    rows. The lists hold k values, so they are broadcast.
    """
    rows = top_k(df if row_filter is None else df.where(row_filter), row, k).select(row)
    cols = top_k(df if col_filter is None else df.where(col_filter), col, k_col or k).select(col)
    return (
        df.select(row, col)
        .join(F.broadcast(rows), row, "left_semi")
        .join(F.broadcast(cols), col, "left_semi")
        .groupBy(row, col)
        .agg(F.count("*").alias("n"))
    )


def widen(long: DataFrame, row: str, col: str, values: Sequence[str] | None = None) -> DataFrame:
    """Crosstab in wide form with zeros for pairs that never occur.

    Without ``values`` every value of ``long`` becomes a column: its top-k list bounds them.
    """
    if values is None:
        values = sorted(r[0] for r in long.select(col).distinct().collect())
    return long.groupBy(row).pivot(col, list(values)).agg(F.sum("n")).na.fill(0)


def topk_by_flag(df: DataFrame, category: str, flag: str, k: int) -> DataFrame:
    """Counts by (category, flag) for the k most frequent categories."""
    top = top_k(df, category, k).select(category, F.col("n").alias("n_category"))
    return (
        df.join(F.broadcast(top), category)
        .groupBy(category, "n_category", flag)
        .agg(F.count("*").alias("n"))
    )


def box_stats(df: DataFrame, by: str, value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (last value within the fences) and outlier count per group."""
    quartiles = (
        exact_quantiles(df, value, [0.25, 0.5, 0.75], by=[by])
        .groupBy(by)
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
               for p, n in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]])
    )
    reach = whisker * (F.col("q75") - F.col("q25"))
    v = F.col(value).cast("double")
    inside = v.between(F.col("q25") - reach, F.col("q75") + reach)
    present = df.select(by, value).where(F.col(value).isNotNull() & ~F.isnan(v))
    return (
        present.join(quartiles, by)
        .groupBy(by, "q25", "q50", "q75")
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class). One row per class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))  # over one row per class
    return counts.select(
        label,
        "n",
        (F.sum("n").over(everything) / (F.count("*").over(everything) * F.col("n"))).alias("weight"),
    )


def category_overlap(df: DataFrame, category: str, label: str = "label") -> DataFrame:
    """Per category, which classes it occurs in: ``both``, ``positive`` or ``negative``."""
    sides = (
        df.where(F.col(category).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(category)
        .agg(F.max((F.col(label) == 1)).alias("_p"), F.max((F.col(label) == 0)).alias("_n"))
    )
    where = F.when(F.col("_p") & F.col("_n"), "both").when(F.col("_p"), "positive").otherwise("negative")
    return sides.select(category, where.alias("found_in"))


def overlap_counts(df: DataFrame, category: str, label: str = "label") -> DataFrame:
    found = category_overlap(df, category, label)
    return found.agg(
        F.count_if(F.col("found_in") != "negative").alias("n_positive"),
        F.count_if(F.col("found_in") != "positive").alias("n_negative"),
        F.count_if(F.col("found_in") == "both").alias("n_both"),
        F.count_if(F.col("found_in") == "positive").alias("n_only_positive"),
        F.count_if(F.col("found_in") == "negative").alias("n_only_negative"),
    )
