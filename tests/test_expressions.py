import math

import pytest
from pyspark.sql import functions as F

from labelaudit.functions import expressions as E


def values(spark, expr, *cells, schema="c string"):
    df = spark.createDataFrame([(c,) for c in cells], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_labels(spark):
    assert values(spark, E.default_label("c"), None, 0, 1, schema="c int") == [1, 0, 1]
    assert values(spark, E.binarize("c", "coded"), "coded", "other", None) == [1, 0, 0]


def test_notes_ignore_case_and_missing(spark):
    got = values(spark, E.matches_note("c", ["remove", "unsure|usure"]), "REMOVE it", "Usure", "fine", None)
    assert got == [True, True, False, False]


def test_changed_is_null_safe(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (None, None), (None, 1)], "a int, b int")
    assert [r[0] for r in df.select(E.changed("a", "b")).collect()] == [False, True, False, True]


def test_ellipsize(spark):
    assert values(spark, E.ellipsize("c", 3), "abc", "abcd", None) == ["abc", "abc...", None]


def test_replacements(spark):
    assert values(spark, E.replace_values("c", {"a": "b", "b": "c"}), "a", "b", "d", None) == ["b", "c", "d", None]
    got = values(spark, E.replace_pattern("c", "^long name.*", "short"), "long name of it", "a long name", "long name\nx")
    assert got == ["short", "a long name", "short\nx"]


def test_prompt_keeps_missing(spark):
    assert values(spark, E.prompt("Say: ", "c"), "x", None) == ["Say: x", None]


def test_decide_at_the_threshold(spark):
    assert values(spark, E.decide("c"), 0.5, 0.49999, None, schema="c double") == [1, 0, None]


def test_softmax(spark):
    (got,) = values(spark, E.softmax("c"), [1000.0, 1000.0 + math.log(3)], schema="c array<double>")
    assert got == pytest.approx([0.25, 0.75])


def test_argmax(spark):
    nan = float("nan")
    got = values(spark, E.argmax_class("c"), [0.1, 0.9], [0.5, 0.5], [nan, -1.0], [nan, 1.0], schema="c array<double>")
    assert got == [1, 0, 0, 1]


def test_dates(spark):
    got = values(
        spark,
        E.parse_dates("c", ["MM/dd/yyyy", "yyyy-MM-dd"]).cast("string"),
        "01/31/2020", "2020-01-31", "13/13/2020", "2020-02-30", "", None,
    )
    assert got == ["2020-01-31", "2020-01-31", None, None, None, None]


def test_months(spark):
    assert values(spark, E.month_of(F.to_date("c")).cast("string"), "2020-02-29") == ["2020-02-01"]
