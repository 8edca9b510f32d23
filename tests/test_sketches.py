"""Sketches: error bounds, and parts that make the whole."""

import random

import pytest
from pyspark.sql import functions as F

from labelaudit.operators import sketches as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(d, rng.randrange(4000), rng.choice([-1, 1, 1]) * rng.lognormvariate(0, 3)) for d in range(8) for _ in range(2500)]
    odd = [(9, None, None), (9, 5, float("nan")), (9, 5, float("inf")), (9, 5, 0.0), (9, 5, -0.0)]
    return spark.createDataFrame(data + odd, "day int, user long, value double").cache()


def test_distinct_counts_of_any_range(rows):
    days = S.distinct_sketch(rows, "user", ["day"])
    for low, high in ((0, 1), (2, 5), (0, 10)):
        some = rows.where(F.col("day").between(low, high))
        merged = S.merged_distinct(days.where(F.col("day").between(low, high)))
        assert sorted(merged.collect()) == sorted(S.distinct_sketch(some, "user").collect())
        true = some.select("user").distinct().where("user IS NOT NULL").count()
        assert abs(S.distinct_estimate(merged).first()["n"] - true) < 4 * 1.04 / 64 * true
    one = S.distinct_estimate(days, ["day"]).where("day = 9").first()["n"]
    assert round(one) == 1


def test_many_distinct_values(spark):
    sketch = S.distinct_sketch(spark.range(300_000), "id")
    assert abs(S.distinct_estimate(sketch).first()["n"] / 300_000 - 1) < 4 * 1.04 / 64 and sketch.count() == 4096
    with pytest.raises(ValueError):
        S.distinct_sketch(spark.range(3), "id", bits=10)


def test_quantiles_of_any_range(rows):
    days = S.quantile_sketch(rows, "value", ["day"])
    probs = [0.0, 0.01, 0.3, 0.5, 0.9, 0.999, 1.0]
    for low, high in ((0, 0), (3, 6), (0, 10)):
        some = rows.where(F.col("day").between(low, high))
        merged = S.merged_quantiles(days.where(F.col("day").between(low, high)))
        assert sorted(merged.collect()) == sorted(S.quantile_sketch(some, "value").collect())
        values = sorted(r[0] for r in some.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('inf')").select("value").collect())
        for r in S.quantile_estimate(merged, probs).collect():
            true = values[max(0, -int(-r["prob"] * len(values) // 1) - 1)]
            assert abs(r["value"] - true) <= 0.0101 * abs(true)
    assert S.quantile_estimate(days.where("day = 9"), [0.5], ["day"]).first()["value"] == 0.0


def test_sketches_of_nothing(rows):
    none = rows.where("day > 99")
    assert S.distinct_estimate(S.distinct_sketch(none, "user", ["day"]), ["day"]).collect() == []
    assert S.quantile_estimate(S.quantile_sketch(none, "value", ["day"]), [0.5], ["day"]).collect() == []
