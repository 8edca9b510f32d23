"""Ranks, running sums and exact quantiles without one task per group.

A plain window puts each group into one task. Here the rows are range-partitioned
on (group, order), so a group spans as many partitions as it needs; each
partition sums locally, and the sums of the partitions before it are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelaudit.session import settle

_SLICE, _CELL = "_slice", "_cell"


def _named(columns: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    slice_by: Column | None = None,
) -> DataFrame:
    """Add ``<name>_upto`` (inclusive) and ``<name>_total`` for each sum.

    ``order`` must be total within a group: end it with a unique key, or group
    by the value first. Otherwise ties both make results vary and may fill one
    partition.

    ``slice_by`` is an expression that never decreases along ``order`` and
    spreads rows evenly, such as a prefix of a hash. With it the plan stays
    lazy. Without it Spark samples range bounds, and the partition numbers are
    written out once so that both later readers see the same ones. Pass narrow
    rows: they are all shuffled.
    """
    order = _named(order)
    keys = [F.col(c) for c in by]
    if slice_by is not None:
        sliced = df.withColumn(_SLICE, slice_by)
    else:
        sliced = settle(
            df.repartitionByRange(*keys, *order).withColumn(_SLICE, F.spark_partition_id())
        )
    # one key for window and join, so the rows move once; inside a struct, NULLs are equal
    sliced = sliced.withColumn(_CELL, F.struct(_SLICE, *by)).drop(_SLICE)
    # one row per slice and group: sized by partitions, not by rows
    cells = sliced.groupBy(_CELL).agg(*[F.sum(s).alias(f"_s_{n}") for n, s in sums.items()])
    group = Window.partitionBy(*([F.col(f"{_CELL}.{c}") for c in by] or [F.lit(0)]))
    before = group.orderBy(f"{_CELL}.{_SLICE}").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        _CELL,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(group).alias(f"{n}_total") for n in sums],
    )
    local = Window.partitionBy(_CELL).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = sliced.select("*", *[F.sum(s).over(local).alias(f"_l_{n}") for n, s in sums.items()])
    out = summed.join(cells, _CELL)
    for n in sums:
        out = out.withColumn(f"{n}_upto", F.col(f"_l_{n}") + F.col(f"_b_{n}"))
    return out.select(*df.columns, *[c for n in sums for c in (f"{n}_upto", f"{n}_total")])


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    slice_by: Column | None = None,
    name: str = "rank",
) -> DataFrame:
    """Add the 1-based position within the group, and ``<name>_total``, its size."""
    out = running_totals(df, by, order, {"_n": F.lit(1).cast("bigint")}, slice_by)
    return out.withColumnsRenamed({"_n_upto": name, "_n_total": f"{name}_total"})


def shuffled_rank(df: DataFrame, by: Sequence[str], key: str, name: str = "rank") -> DataFrame:
    """Rank by a column of uniform hex text; its first digits are the slices."""
    return ranked(df, by, [key], slice_by=F.substring(F.col(key), 1, 4), name=name)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Linear-interpolated quantiles: one row per group and probability.

    Rows are first counted per distinct value, so ties cost nothing; missing
    values and NaN are left out.
    """
    by = list(by)
    v = F.col(value).cast("double")
    counts = (
        df.select(*by, v.alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    placed = running_totals(counts, by, ["_v"], {"_n": F.col("_c")})
    first, last = F.col("_n_upto") - F.col("_c"), F.col("_n_upto") - 1
    picks = []
    for i, q in enumerate(probs):
        at = F.lit(float(q)) * (F.col("_n_total") - 1)
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when((first <= low) & (low <= last), F.col("_v"))).alias(f"_lo{i}"),
            F.max(F.when((first <= high) & (high <= last), F.col("_v"))).alias(f"_hi{i}"),
            F.max(at - low).alias(f"_w{i}"),
        ]
    rows = [
        F.struct(
            F.lit(float(q)).alias("prob"),
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias("value"),
        )
        for i, q in enumerate(probs)
    ]
    return placed.groupBy(*by).agg(*picks).select(*by, F.inline(F.array(*rows)))
