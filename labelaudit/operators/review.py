"""Review ledger and corrections, as table operations keyed by text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelaudit.functions.expressions import changed, matches_note, text_key
from labelaudit.operators.assemble import exclude, salted_join
from labelaudit.sources.schemas import REVIEWED
from labelaudit.sources.tables import read_or_empty

# Notes that take a decision out of use.
REMOVED_NOTES = ("remove",)
UNSURE_NOTES = ("unsure|usure",)


def usable(reviewed: DataFrame, patterns: Sequence[str] = (*REMOVED_NOTES, *UNSURE_NOTES)) -> DataFrame:
    """Decisions without a note that marks them for removal or as unsure."""
    return reviewed.where(~matches_note("reviewer_notes", patterns))


def with_changed(reviewed: DataFrame) -> DataFrame:
    return reviewed.withColumn("updated", changed("given_label", "final_label"))


def _checked(answer: Column, new_label: Column) -> tuple[Column, Column]:
    yes, no = answer == "y", answer == "n"
    valid = F.coalesce(no | (yes & new_label.isin(0, 1)), F.lit(False))
    reason = F.when(F.coalesce(~(yes | no), F.lit(True)), "answer is not y or n").otherwise(
        "new label is not 0 or 1"
    )
    return valid, reason


def conform_decisions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split raw decisions into valid ledger rows and rejects with a reason.

    ``raw`` holds the suspect's columns plus ``answer`` (y/n, any case),
    ``new_label`` as text, ``reviewer_notes`` and ``review_date``. Answer ``n``
    keeps the given label, whatever ``new_label`` says.
    """
    answer = F.lower(F.trim("answer"))
    new_label = F.trim("new_label").try_cast("int")
    valid, reason = _checked(answer, new_label)
    final = F.when(answer == "y", new_label).otherwise(F.col("given_label"))
    good = raw.where(valid).select(
        "text",
        "category",
        "given_label",
        "suggested_label",
        final.alias("final_label"),
        "review_date",
        F.trim("reviewer_notes").alias("reviewer_notes"),
    )
    return good, raw.where(~valid).withColumn("reason", reason)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, REVIEWED)


def append_decisions(batch: DataFrame, path: str) -> None:
    """Add decisions; nothing already in the ledger is rewritten."""
    batch.write.mode("append").parquet(path)


def latest_decisions(reviewed: DataFrame) -> DataFrame:
    """One decision per text: the latest, then the larger label.

    Texts stay behind: the result is (text_key, final_label, review_date).
    """
    newest = F.max(F.struct("review_date", "final_label")).alias("_d")
    return (
        reviewed.where(F.col("text").isNotNull())
        .groupBy(text_key("text").alias("text_key"))
        .agg(newest)
        .select("text_key", "_d.final_label", "_d.review_date")
    )


def pending(
    suspects: DataFrame, reviewed: DataFrame, text: str = "text", row_id: str | None = None
) -> DataFrame:
    """Suspects whose text has no decision yet."""
    return exclude(suspects, reviewed, text, "text", row_id)


def next_batch(
    suspects: DataFrame,
    reviewed: DataFrame,
    order: Sequence[Column | str],
    n: int = 10,
    row_id: str | None = None,
) -> DataFrame:
    """The first ``n`` pending suspects. ``order`` must end with a unique key."""
    return pending(suspects, reviewed, row_id=row_id).orderBy(*order).limit(n)


def review_stats(suspects: DataFrame, reviewed: DataFrame, row_id: str | None = None) -> DataFrame:
    """Decisions, changed labels with their percentage, and suspects still open.

    Open suspects are counted, so the number never goes below zero.
    """
    is_changed = changed("given_label", "final_label")
    left = pending(suspects, reviewed, row_id=row_id).agg(F.count("*")).scalar()
    return reviewed.agg(
        F.count("*").alias("n_reviewed"),
        F.count_if(is_changed).alias("n_changed"),
        F.try_divide(F.count_if(is_changed) * 100.0, F.count("*")).alias("pct_changed"),
    ).withColumn("n_remaining", left)


def apply_corrections(
    corpus: DataFrame,
    reviewed: DataFrame,
    content: str = "content",
    label: str = "label",
    row_id: str = "row_id",
) -> DataFrame:
    """Reviewed labels override the given ones; the row count never changes.

    Decisions are first reduced to one per text, so a text reviewed twice does
    not multiply rows, and every other column stays with its row. Texts are compared
    on narrow rows; the corpus meets the new labels by ``row_id``, which is unique.
    """
    decisions = latest_decisions(reviewed).select("text_key", F.col("final_label").alias("_final"))
    narrow = corpus.where(F.col(content).isNotNull()).select(row_id, text_key(content).alias("text_key"))
    new = salted_join(narrow, decisions, "text_key", row_id).select(row_id, "_final")
    fixed = corpus.join(new, row_id, "left").withColumn(label, F.coalesce("_final", label))
    return fixed.select(*corpus.columns)


def corrected_corpus(
    corpus: DataFrame,
    reviewed: DataFrame,
    suspects: DataFrame,
    near_copies: DataFrame,
    content: str = "content",
    label: str = "label",
    row_id: str = "row_id",
) -> DataFrame:
    """Corrections applied; open suspects and near copies removed by text.

    ``suspects`` and ``near_copies`` hold a ``text`` column. Decisions marked
    for removal or unsure count as no decision.
    """
    kept = usable(reviewed)
    open_cases = pending(suspects, kept, row_id=row_id if row_id in suspects.columns else None)
    fixed = apply_corrections(corpus, kept, content, label, row_id)
    unwanted = open_cases.select("text").union(near_copies.select("text"))
    return exclude(fixed, unwanted, content, "text", row_id)
