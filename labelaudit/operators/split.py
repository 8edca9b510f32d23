"""Deterministic splits. Sizes are exact and a re-run gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from labelaudit.functions.expressions import shuffle_key
from labelaudit.operators.ordering import shuffled_rank

_KEY, _PLACE = "_shuffle", "_place"


def _ranked(df: DataFrame, row_id: str, by: Sequence[str], seed: int) -> DataFrame:
    narrow = df.select(row_id, *by, shuffle_key(row_id, seed).alias(_KEY))
    return shuffled_rank(narrow, by, _KEY, name=_PLACE)


def _split(df: DataFrame, by: Sequence[str], frac: float, seed: int, row_id: str) -> DataFrame:
    taken = F.col(_PLACE) <= F.round(F.col(f"{_PLACE}_total") * F.lit(float(frac)))
    return _ranked(df, row_id, by, seed).select(
        row_id, *by, F.when(taken, "val").otherwise("train").alias("split")
    )


def stratified_split(
    df: DataFrame, label: str = "label", frac: float = 0.1, seed: int = 42, row_id: str = "row_id"
) -> DataFrame:
    """(row_id, label, split): ``val`` holds round(rows * frac) of each class.

    Only keys are ranked; join the result back on ``row_id`` for more columns.
    Rows without a label belong to no class and are left out.
    """
    return _split(df.where(F.col(label).isNotNull()), [label], frac, seed, row_id)


def random_split(df: DataFrame, frac: float = 0.1, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    return _split(df, [], frac, seed, row_id)


def stratified_subset(
    df: DataFrame, frac: float, label: str = "label", seed: int = 42, row_id: str = "row_id"
) -> DataFrame:
    """The share of each class that tuning runs use."""
    return stratified_split(df, label, frac, seed, row_id).where("split = 'val'").drop("split")


def fold_assignment(df: DataFrame, k: int = 5, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """(row_id, fold): shuffled folds whose sizes differ by at most one."""
    placed = _ranked(df, row_id, [], seed)
    return placed.select(row_id, ((F.col(_PLACE) - 1) % k).cast("int").alias("fold"))


def split_report(splits: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Rows and label shares of each part and of the whole (``full``)."""
    counts = splits.groupBy(split, label).agg(F.count("*").alias("n"))
    full = counts.groupBy(label).agg(F.sum("n").alias("n")).withColumn(split, F.lit("full"))
    both = counts.unionByName(full)
    part = Window.partitionBy(split)
    return both.withColumn("n_split", F.sum("n").over(part)).withColumn(
        "share", F.col("n") / F.col("n_split")
    )
