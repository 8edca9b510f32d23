import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from labelaudit.operators import ordering as O, profile as P, split as S, trend as R

few = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, n, groups, seed=0):
    """A third of the rows in one group, and many equal values."""
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "id": np.arange(n),
                "g": np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, groups + 1, n)),
                "v": rng.integers(0, 20, n) / 4.0,
            }
        )
    )


def test_ranked_equals_a_window(spark):
    df = frame(spark, 500, 4)
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "id")))
    got = O.ranked(df, ["g"], [F.desc("v"), F.asc("id")])
    assert got.join(want.select("id", "w"), "id").where("rank != w").count() == 0
    assert got.count() == 500
    assert got.groupBy("g").agg(F.max("rank").alias("m"), F.max("rank_total").alias("t")).where("m != t").count() == 0


def test_ranked_keeps_missing_groups(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "id int, g int")
    got = {r.id: (r["rank"], r.rank_total) for r in O.ranked(df, ["g"], ["id"]).collect()}
    assert got == {1: (1, 2), 2: (2, 2), 3: (1, 1)}


@few
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))
def test_quantiles_equal_numpy(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = O.exact_quantiles(df, "v", [q]).first().value
    assert got == pytest.approx(float(np.quantile(values, q)))


def test_quantiles_skip_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (2.0,)], "v double")
    assert O.exact_quantiles(df, "v", [0.5]).first().value == 1.5
    assert O.exact_quantiles(df.where("v IS NULL"), "v", [0.5], by=[]).where("value IS NOT NULL").count() == 0


def test_describe_approx_agrees(spark):
    df = frame(spark, 300, 3)
    exact, approx = P.describe(df, ["v"]).first(), P.describe(df, ["v"], approx=True).first()
    assert (exact.n, exact["min"], exact["max"]) == (approx.n, approx["min"], approx["max"])
    assert approx.q50 == pytest.approx(exact.q50, abs=0.25)


def test_box_stats(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]], "g string, v double")
    r = P.box_stats(df, "g", "v").first()
    assert (r.q25, r.q50, r.q75, r.whisker_low, r.whisker_high, r.n_outliers) == (2, 3, 4, 1, 4, 1)


def test_stratified_sizes(spark):
    df = spark.range(399).selectExpr("id AS row_id", "CASE WHEN id < 58 THEN 0 ELSE 1 END AS label")
    split = S.stratified_split(df, frac=0.1)
    got = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert got == {(0, "val"): 6, (0, "train"): 52, (1, "val"): 34, (1, "train"): 307}
    again = S.stratified_split(df.repartition(7), frac=0.1)
    assert split.exceptAll(again).count() == 0
    other = S.stratified_split(df, frac=0.1, seed=7)
    assert split.exceptAll(other).count() > 0


def test_folds_are_even(spark):
    folds = S.fold_assignment(spark.range(103).selectExpr("id AS row_id"), 5)
    sizes = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]


def test_split_report(spark):
    df = spark.range(40).selectExpr("id AS row_id", "CAST(id % 2 AS INT) AS label")
    got = {(r.split, r.label): (r.n, r.share) for r in S.split_report(S.stratified_split(df, frac=0.1)).collect()}
    assert got[("full", 1)] == (20, 0.5) and got[("val", 0)] == (2, 0.5)


def test_even_window_leans_back(spark):
    df = spark.createDataFrame([(i, 10**i) for i in range(7)], "m int, n long")
    got = [round(r.smoothed, 1) for r in R.smooth(df, [], "m", 6).orderBy("m").collect()]
    assert got == [37.0, 277.8, 2222.2, 18518.5, 185185.0, 222220.0, 277750.0]


def test_years_between_are_zero(spark):
    df = spark.createDataFrame([("a", "2018-01-01"), ("a", "2020-05-05")], "c string, d string").withColumn("d", F.to_date("d"))
    got = [(r.year, r.n) for r in R.yearly_trend(df, "c", "d", 10).orderBy("year").collect()]
    assert got == [(2018, 1), (2019, 0), (2020, 1)]
