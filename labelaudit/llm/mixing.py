"""Mixing sources to target weights.

Words are summed per source, each source's share of the whole gives a target, and
the target over the source's own words is the repetition rate of its documents. A
document is emitted floor(rate) times, and once more when a draw seeded by its
hash falls below the fraction. Nothing but one row per source is shuffled; the
draw needs no state, so a rerun or a retried task emits the same rows.

Defined results: a missing text has size 0; a missing source is a source of its
own; a source of size 0 has rate 0; equal rows (same id, same text) draw alike;
an empty table gives an empty mix. Columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelaudit.llm.frames import WORD, hidden, shown
from labelaudit.operators.ordering import ranked
from labelaudit.session import settle


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the document alone."""
    none = F.lit("")
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), none), F.coalesce(text, none))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cycled_weights(sources: DataFrame, source: str, cycle: int = 3) -> DataFrame:
    """Weights 1 to ``cycle``, over and over, by code point of the source, missing last."""
    order = [F.col(source).asc_nulls_last()]
    placed = ranked(sources.select(source).distinct(), [], order, name="_rank")
    return placed.select(source, ((F.col("_rank") - 1) % cycle + 1).cast("long").alias("weight"))


def source_targets(sizes: DataFrame, weights: DataFrame | None, max_repeat: int) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    ``sizes`` has source and size, ``weights`` source and weight (a source without
    one counts 0; no table: all alike). A target stops at ``max_repeat`` times the
    source; what is left over goes to the others by weight, until none is above.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        table = table.withColumn("weight", F.lit(1).cast("long"))
    else:
        w = weights.select(F.col("source").alias("_s"), "weight")
        table = table.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        table = table.withColumn("weight", F.coalesce("weight", F.lit(0)))
    table = settle(table)
    full = F.col("source_size") * max_repeat
    total, free = table.agg(F.sum("source_size"), F.sum("weight")).first()
    left, level, stopped = total or 0, 0.0, -1
    while free:  # each turn stops one source more at least
        level = left / free
        above = F.col("weight") * F.lit(level) > full
        n, taken, free = table.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, full)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        if n == stopped:
            break
        left, stopped = (total or 0) - taken, n
    share = (F.col("weight") * F.lit(level)).cast("double")
    return table.withColumn("target", F.when(share > full, full.cast("double")).otherwise(share))


def copies(
    docs: DataFrame,
    weights=None,
    max_repeat: int = 3,
    seed: str = "mix",
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, dict[str, str]]:
    """Per document: the hidden input columns, size, source_size, target, copies.

    ``weights`` is a table of source and weight, or a function that makes one from
    a table with the column ``source``.
    """
    rows, names = hidden(docs)
    body = F.col(names[text])
    drawn = draw(F.col(names[doc_id]), body, seed)  # before the join, so that a plan without texts moves none
    sized = rows.withColumns({"size": word_count(body), "_draw": drawn})
    narrow = sized.select(F.col(names[source]).alias("source"), "size")
    if callable(weights):
        weights = weights(narrow)
    targets = source_targets(narrow, weights, max_repeat).withColumnRenamed("source", "_source")
    out = sized.join(targets, F.col(names[source]).eqNullSafe(F.col("_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.least(rate, F.lit(float(max_repeat)))
    more = F.col("_draw") < rate - F.floor(rate)
    n = F.floor(rate) + more.cast("long")
    return out.withColumn("copies", n).drop("_source", "weight", "_draw"), names


def mix(docs: DataFrame, weights=None, copy: str = "copy", **options) -> DataFrame:
    """Every document as often as the mix takes it, numbered from 1 in the column ``copy``."""
    counted, names = copies(docs, weights, **options)
    turns = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias(copy)
    return shown(counted.where("copies > 0"), names, turns)
