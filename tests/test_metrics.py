import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelaudit.operators import metrics as M


def from_cells(spark, tn, fp, fn, tp):
    rows = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)]
    cells = spark.createDataFrame(rows, "true_label int, predicted_label int, n int")
    return cells.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("n")))).drop("_", "n")


# published cells and scores of three prediction files
@pytest.mark.parametrize(
    "cells, accuracy, f1",
    [((45, 5, 50, 1), 0.455446, 0.035088), ((46, 4, 32, 19), 0.643564, 0.513514), ((48, 3, 30, 20), 0.673267, 0.547945)],
)
def test_published_scores(spark, cells, accuracy, f1):
    preds = from_cells(spark, *cells)
    row = M.binary_metrics(preds).first()
    assert (row.tn, row.fp, row.fn, row.tp) == cells
    assert (row.accuracy, row.f1) == pytest.approx((accuracy, f1), abs=1e-6)
    matrix = {(r.true_label, r.predicted_label): r.n for r in M.confusion(preds).collect()}
    assert matrix == dict(zip([(0, 0), (0, 1), (1, 0), (1, 1)], cells))


def test_published_report(spark):
    preds = from_cells(spark, 45, 5, 50, 1)
    got = {r["class"]: (round(r.precision, 2), round(r.recall, 2), round(r.f1, 2), r.support) for r in M.class_report(preds).collect()}
    assert got == {0: (0.47, 0.90, 0.62, 50), 1: (0.17, 0.02, 0.04, 51)}
    avg = {r.average: (round(r.precision, 2), round(r.recall, 2), round(r.f1, 2), r.support) for r in M.class_report_avg(preds).collect()}
    assert avg == {"macro avg": (0.32, 0.46, 0.33, 101), "weighted avg": (0.32, 0.46, 0.32, 101)}


def test_empty_denominators_are_zero(spark):
    row = M.binary_metrics(from_cells(spark, 3, 0, 0, 0)).first()
    assert (row.precision, row.recall, row.f1, row.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_confusion_rejects_other_labels(spark):
    preds = spark.createDataFrame([(0, 2)], "true_label int, predicted_label int")
    with pytest.raises(Exception, match="outside"):
        M.confusion(preds).collect()


def scored(spark, seed=1, n=400):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(0.3 * y + rng.random(n) * 0.7, 0, 1), 2)  # many ties
    return spark.createDataFrame(pd.DataFrame({"true_label": y.astype("int32"), "probability": p})), y, p


def test_auc_counts_ties_half(spark):
    df, y, p = scored(spark)
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert M.roc_auc(df).first().auc == pytest.approx(want)
    flipped = df.withColumn("probability", 1 - F.col("probability"))
    assert M.roc_auc(flipped).first().auc == pytest.approx(1 - want)


def test_auc_edges(spark):
    same = spark.createDataFrame([(0, 0.3), (1, 0.3), (1, 0.3)], "true_label int, probability double")
    assert M.roc_auc(same).first().auc == 0.5
    assert M.roc_auc(same.where("true_label = 1")).first().auc is None
    nan = same.unionByName(spark.createDataFrame([(0, float("nan"))], same.schema))
    assert M.roc_auc(nan).first().auc == 0.5


def test_roc_area_equals_auc(spark):
    df, _, _ = scored(spark, 2)
    points = M.roc_curve(df).toPandas().sort_values(["fpr", "tpr"])
    assert np.trapezoid(points.tpr, points.fpr) == pytest.approx(M.roc_auc(df).first().auc)
    assert points.threshold.isna().sum() == 1 and points.tpr.max() == 1.0


def test_log_loss(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.4)], "true_label int, probability double")
    plain = -(np.log(0.8) + np.log(0.6)) / 2
    assert M.log_loss(df).first().log_loss == pytest.approx(plain)
    weights = spark.createDataFrame([(0, 1.0), (1, 3.0)], "true_label int, weight double")
    assert M.log_loss(df, weights).first().log_loss == pytest.approx(-(3 * np.log(0.8) + np.log(0.6)) / 4)


def test_diff(spark):
    a = spark.createDataFrame([(1, 0, "x"), (2, None, "y"), (3, 1, "z")], "k int, l int, t string")
    b = spark.createDataFrame([(1, 1, "x"), (2, None, "y"), (4, 1, "z")], "k int, l int, t string")
    got = sorted((r.k, r.column_name, r.before, r.after) for r in M.diff_tables(a, b, "k", ["l", "t"]).collect())
    assert [g[:2] for g in got] == [(1, "l"), (3, "l"), (3, "t"), (4, "l"), (4, "t")]


@pytest.mark.parametrize("bad", [(None, 1, 0.5), (2, 1, 0.5), (1, None, 0.5)])
def test_unknown_labels_are_an_error(spark, bad):
    df = spark.createDataFrame([(1, 1, 0.9), bad], "true_label int, predicted_label int, probability double")
    with pytest.raises(Exception, match="outside the expected set"):
        M.binary_metrics(df).collect()
    if bad[0] != 1:
        with pytest.raises(Exception, match="outside the expected set"):
            M.log_loss(df).collect()


def test_a_variant_without_scores_keeps_its_counts(spark):
    rows = [("a", 1, 1, 0.9), ("a", 0, 0, 0.1), ("b", 1, 1, None), ("b", 0, 1, None)]
    df = spark.createDataFrame(rows, "v string, true_label int, predicted_label int, probability double")
    got = {r.metric: (r.baseline, r.candidate) for r in M.compare_variants(df, "v", "a", "b").collect()}
    assert got["accuracy"] == (1.0, 0.5) and got["auc"] == (1.0, None)
