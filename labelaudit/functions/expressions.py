"""Column expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def default_label(label: Column | str, value: int = 1) -> Column:
    """Missing label becomes ``value``."""
    return F.coalesce(_col(label), F.lit(value))


def binarize(label: Column | str, positive: str) -> Column:
    """1 where the label equals ``positive``, else 0 (also for missing)."""
    return F.when(_col(label) == positive, 1).otherwise(0)


def matches_note(note: Column | str, patterns: Sequence[str]) -> Column:
    """True when any pattern occurs in the note, ignoring case; missing is False."""
    hits = [F.coalesce(_col(note).rlike(f"(?i){p}"), F.lit(False)) for p in patterns]
    return reduce(lambda a, b: a | b, hits)


def changed(given: Column | str, final: Column | str) -> Column:
    """Null-safe inequality: two missing values count as unchanged."""
    return ~_col(given).eqNullSafe(_col(final))


def ellipsize(text: Column | str, width: int = 20) -> Column:
    """First ``width`` characters plus ``...`` for longer values."""
    c = _col(text)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def replace_values(value: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace whole values by exact match."""
    c = _col(value)
    if not mapping:
        return c
    branches = [(c == old, F.lit(new)) for old, new in mapping.items()]
    head, *rest = branches
    expr = F.when(*head)
    for condition, new in rest:
        expr = expr.when(condition, new)
    return expr.otherwise(c)


def replace_pattern(value: Column | str, pattern: str, new: str) -> Column:
    """Replace what ``pattern`` matches; anchor it to replace whole values."""
    return F.regexp_replace(_col(value), pattern, new)


def prompt(template: str, content: Column | str) -> Column:
    """Constant instruction followed by the content; missing content stays missing."""
    return F.concat(F.lit(template), _col(content))


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(_col(text), F.lit(""))


def decide(probability: Column | str, threshold: float = 0.5) -> Column:
    """1 at or above the threshold."""
    return (_col(probability) >= F.lit(threshold)).cast("int")


def softmax(logits: Column | str) -> Column:
    """Probabilities from an array of logits, shifted by the maximum."""
    c = _col(logits)
    exps = F.transform(c, lambda x: F.exp(x - F.array_max(c)))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda x: x / total)


def argmax_class(scores: Column | str) -> Column:
    """Index of the largest score; NaN counts as 0, a tie goes to the lower class."""
    clean = F.transform(_col(scores), lambda x: F.nanvl(x, F.lit(0.0)))
    return (F.array_position(clean, F.array_max(clean)) - 1).cast("int")


def parse_dates(text: Column | str, formats: Sequence[str]) -> Column:
    """First format that parses wins; text that fits none becomes missing."""
    c = _col(text)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def month_of(ts: Column | str) -> Column:
    return F.trunc(_col(ts), "month")


def text_key(text: Column | str) -> Column:
    """Fixed-width stand-in for a text in joins and groupings."""
    return F.sha2(_col(text), 256)


def shuffle_key(row_id: Column | str, seed: int) -> Column:
    """Repeatable pseudo-random order: uniform hex text, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(row_id).cast("string")))
