"""Evaluation of prediction tables: ``true_label``, ``predicted_label``, ``probability``.

``by`` names the columns that tell result sets apart (model, dataset, variant),
so all of them are evaluated in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from labelaudit.functions.expressions import decide
from labelaudit.operators.assemble import salted_join
from labelaudit.operators.ordering import exact_quantiles, running_totals
from labelaudit.session import settle, store

_OUTSIDE = "label outside the expected set"


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives 0 for an empty denominator."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def with_decision(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("predicted_label", decide("probability", threshold))


def confusion(preds: DataFrame, by: Sequence[str] = (), labels: Sequence[int] = (0, 1)) -> DataFrame:
    """One row per (true, predicted) pair of ``labels``, zero cells included.

    Fails when a label outside ``labels`` occurs, rather than dropping its rows.
    """
    pairs = [(t, p) for t in labels for p in labels]
    true, pred = F.col("true_label"), F.col("predicted_label")
    known = true.isin(*labels) & pred.isin(*labels)
    counted = preds.groupBy(*by).agg(
        *[F.count_if((true == t) & (pred == p)).alias(f"_{t}_{p}") for t, p in pairs],
        F.count_if(~F.coalesce(known, F.lit(False))).alias("_other"),
    )
    cells = [
        F.struct(
            F.lit(t).alias("true_label"),
            F.lit(p).alias("predicted_label"),
            F.when(
                F.col("_other") > 0,
                F.raise_error(F.lit(_OUTSIDE)).cast("bigint"),
            )
            .otherwise(F.col(f"_{t}_{p}"))
            .alias("n"),
        )
        for t, p in pairs
    ]
    return counted.select(*by, F.inline(F.array(*cells)))


def _pairs(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per (true, predicted) pair: all that the counting metrics need."""
    return preds.groupBy(*by, "true_label", "predicted_label").agg(F.count("*").alias("n"))


def _quadrants(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    def cell(true: int, predicted: int) -> Column:
        hit = (F.col("true_label") == true) & (F.col("predicted_label") == predicted)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    known = F.col("true_label").isin(0, 1) & F.col("predicted_label").isin(0, 1)
    counted = pairs.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"),
        F.count_if(~F.coalesce(known, F.lit(False))).alias("_other"),
    )
    checked = F.when(F.col("_other") > 0, F.raise_error(F.lit(_OUTSIDE)).cast("bigint"))
    return counted.withColumn("tp", checked.otherwise(F.col("tp"))).drop("_other")


def binary_metrics(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and balanced accuracy of class 1.

    Fails when a label or prediction is missing or neither 0 nor 1, as :func:`confusion`.
    """
    return _binary(_pairs(preds, by), by)


def _binary(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return _quadrants(pairs, by).select(
        *by,
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
    )


def class_report(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support for every class seen as true or predicted."""
    return _report(_pairs(preds, by), by)


def _report(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    hit = F.col("true_label") == F.col("predicted_label")
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("true_label").alias("class"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
            F.when(hit, F.col("n")).otherwise(zero).alias("tp"),
        ),
        F.struct(
            F.col("predicted_label").alias("class"),
            zero.alias("support"),
            F.col("n").alias("predicted"),
            zero.alias("tp"),
        ),
    )
    return (
        pairs.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
        .select(
            *by,
            "class",
            ratio(F.col("tp"), F.col("predicted")).alias("precision"),
            ratio(F.col("tp"), F.col("support")).alias("recall"),
            ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
            "support",
        )
    )


def class_report_avg(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted averages of the class report."""
    return _averages(class_report(preds, by), by)


def _averages(report: DataFrame, by: Sequence[str]) -> DataFrame:
    names = ("precision", "recall", "f1")
    support = F.col("support")
    sums = report.groupBy(*by).agg(
        *[F.avg(n).alias(f"m_{n}") for n in names],
        *[ratio(F.sum(F.col(n) * support), F.sum(support)).alias(f"w_{n}") for n in names],
        F.sum(support).alias("support"),
    )
    rows = [
        F.struct(
            F.lit(kind).alias("average"),
            *[F.col(f"{prefix}_{n}").alias(n) for n in names],
            support,
        )
        for kind, prefix in (("macro avg", "m"), ("weighted avg", "w"))
    ]
    return sums.select(*by, F.inline(F.array(*rows)))


def _by_score(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score; a NaN or missing score is left out."""
    scored = preds.where(F.col("probability").isNotNull() & ~F.isnan("probability"))
    return scored.groupBy(*by, "probability").agg(
        F.count_if(F.col("true_label") == 1).alias("pos"),
        F.count_if(F.col("true_label") == 0).alias("neg"),
    )


def roc_curve(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score plus the origin (threshold NULL).

    Collinear points are kept: they do not change the curve or its area.
    """
    placed = running_totals(
        _by_score(preds, by),
        by,
        [F.desc("probability")],
        {"pos": F.col("pos"), "neg": F.col("neg")},
    )
    points = placed.select(
        *by,
        F.col("probability").alias("threshold"),
        ratio(F.col("neg_upto"), F.col("neg_total")).alias("fpr"),
        ratio(F.col("pos_upto"), F.col("pos_total")).alias("tpr"),
    )
    origin = preds.select(*by).distinct() if by else preds.agg(F.count("*").alias("_n")).drop("_n")
    origin = origin.select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(origin)


def roc_auc(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve; tied scores count one half. NULL with one class only."""
    placed = running_totals(
        _by_score(preds, by), by, ["probability"], {"pos": F.col("pos"), "neg": F.col("neg")}
    )
    below = F.col("neg_upto") - F.col("neg")
    wins = F.col("pos") * (below + F.col("neg") / 2)
    return placed.groupBy(*by).agg(
        F.try_divide(
            F.sum(wins), F.max("pos_total").cast("double") * F.max("neg_total").cast("double")
        ).alias("auc")
    )


def _placements(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group and score: the share of the other class that a positive and a negative of this score outrank."""
    placed = running_totals(_by_score(preds, by), by, ["probability"], {"pos": F.col("pos"), "neg": F.col("neg")})
    below = lambda c: F.col(f"{c}_upto") - F.col(c)
    over = (below("neg") + F.col("neg") / 2) / F.col("neg_total")
    under = (F.col("pos_total") - F.col("pos_upto") + F.col("pos") / 2) / F.col("pos_total")
    return placed.select(*by, "probability", over.alias("_over"), under.alias("_under"))


def compare_auc(preds: DataFrame, variant: str, baseline: str, candidate: str, row_id: str = "row_id") -> DataFrame:
    """One row: both areas, their difference, its standard error, z and two-sided p-value, for variants that score the same rows.

    The covariance of paired areas from placement values: the mean placement of the
    positives is the area, and placements of the same rows under both variants vary
    together. Rows that one variant has no score for are left out of both. A class with
    fewer than two rows gives no error.
    """
    two = preds.where(F.col(variant).isin(baseline, candidate) & F.col("true_label").isin(0, 1))
    two = two.where(F.col("probability").isNotNull() & ~F.isnan("probability"))
    both = two.groupBy(row_id).agg(
        F.max("true_label").alias("label"),
        *[F.max(F.when(F.col(variant) == v, F.col("probability"))).alias(n) for v, n in ((baseline, "a"), (candidate, "b"))],
    ).where("a IS NOT NULL AND b IS NOT NULL")
    both = store(both, "paired-scores")
    rows = both
    for n in ("a", "b"):
        known = _placements(both.select(F.col("label").alias("true_label"), F.col(n).alias("probability")), [])
        rows = salted_join(rows, known, n, row_id, key_r="probability")
        rows = rows.withColumn(f"v_{n}", F.when(F.col("label") == 1, F.col("_over")).otherwise(F.col("_under"))).drop("_over", "_under")
    pos, neg = F.col("label") == 1, F.col("label") == 0
    part = lambda c, one: F.when(one, F.col(c))
    found = rows.agg(
        F.avg(part("v_a", pos)).alias("auc_baseline"),
        F.avg(part("v_b", pos)).alias("auc_candidate"),
        *[
            (F.try_divide(F.var_samp(F.when(one, F.col("v_b") - F.col("v_a"))), F.count_if(one))).alias(name)
            for one, name in ((pos, "_p"), (neg, "_n"))
        ],
    ).select("auc_baseline", "auc_candidate", (F.col("auc_candidate") - F.col("auc_baseline")).alias("difference"),
             F.sqrt(F.col("_p") + F.col("_n")).alias("error"))
    z = F.try_divide(F.col("difference"), F.col("error"))
    return found.withColumn("z", z).withColumn("p_value", two_sided(F.col("z")))


def two_sided(z: Column) -> Column:
    """How likely a standard normal value is to be as far from 0 as ``z``, to seven digits (a rational approximation)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    # fixed values of the approximation
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


#: The distribution function of the Poisson distribution of mean 1 at 0 to 9, in parts of 2**32.
POISSON = [int(2**32 * math.exp(-1.0) * sum(1 / math.factorial(j) for j in range(i + 1))) for i in range(10)]


def bootstrap_counts(preds: DataFrame, variant: str, replicates: int = 100, row_id: str = "row_id") -> DataFrame:
    """(variant, replicate, tn, fp, fn, tp): counts of rows weighted by how often a resample draws them.

    Each row is drawn a Poisson number of times of mean 1, by a hash of its id and the
    replicate: the same for all variants, so that differences are paired, and on any
    partitioning. All replicates are sums of one pass.
    """
    name = lambda r: F.concat_ws(":", F.col(row_id).cast("string"), r.cast("string"))
    draw = lambda r: F.conv(F.substring(F.md5(name(r)), 1, 8), 16, 10).cast("bigint")
    weight = lambda r: sum((draw(r) >= s).cast("long") for s in POISSON)
    reps = preds.select(variant, "true_label", "predicted_label", row_id, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    drawn = reps.select(variant, "replicate", "true_label", "predicted_label", weight(F.col("replicate")).alias("_w"))
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return drawn.groupBy(variant, "replicate").agg(
        *[F.sum(F.when((F.col("true_label") == t) & (F.col("predicted_label") == p), F.col("_w")).otherwise(0)).alias(n) for n, (t, p) in cells.items()]
    )


def bootstrap_interval(
    preds: DataFrame, variant: str, baseline: str, candidate: str, replicates: int = 100, row_id: str = "row_id", tail: float = 0.05
) -> DataFrame:
    """(metric, low, median, high): quantiles over resamples of what the candidate gains in accuracy and F1."""
    counts = store(bootstrap_counts(preds.where(F.col(variant).isin(baseline, candidate)), variant, replicates, row_id), "resamples")
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    values = {"accuracy": F.try_divide(F.col("tn") + F.col("tp"), n), "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))}
    long = counts.select(variant, "replicate", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()])))
    sides = long.groupBy("metric", "replicate").agg(
        *[F.max(F.when(F.col(variant) == v, F.col("value"))).alias(s) for v, s in ((baseline, "a"), (candidate, "b"))]
    )
    found = exact_quantiles(sides.withColumn("gain", F.col("b") - F.col("a")), "gain", [tail / 2, 0.5, 1 - tail / 2], ["metric"])
    names = {tail / 2: "low", 0.5: "median", 1 - tail / 2: "high"}
    return found.groupBy("metric").agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(c) for p, c in names.items()])


def log_loss(
    preds: DataFrame,
    weights: DataFrame | None = None,
    by: Sequence[str] = (),
    eps: float = 1e-15,
) -> DataFrame:
    """Mean negative log likelihood, weighted by ``weights`` (true_label, weight) when given.

    Fails on a label that is missing or neither 0 nor 1, and on one without a weight.
    """
    label = F.col("true_label")
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col("probability")))
    other = F.raise_error(F.lit(_OUTSIDE)).cast("double")
    nll = -F.when(label == 1, F.log(p)).when(label == 0, F.log(1 - p)).otherwise(other)
    if weights is None:
        return preds.groupBy(*by).agg(F.avg(nll).alias("log_loss"))
    joined = preds.join(weights.select("true_label", F.col("weight").alias("_w")), "true_label", "left")
    weight = F.coalesce("_w", F.raise_error(F.lit("a class has no weight")).cast("double"))
    return joined.groupBy(*by).agg(ratio(F.sum(weight * nll), F.sum(weight)).alias("log_loss"))


_COMPARED = ("accuracy", "precision", "recall", "f1", "balanced_accuracy")


def compare_variants(preds: DataFrame, variant: str, baseline: str, candidate: str) -> DataFrame:
    """Each metric for two variants and the difference, one row per metric."""
    two = preds.where(F.col(variant).isin(baseline, candidate))
    scores = binary_metrics(two, [variant]).join(roc_auc(two, [variant]), variant, "left")
    names = [*_COMPARED, "auc"]
    rows = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
    long = scores.select(variant, F.inline(F.array(*rows)))
    return long.groupBy("metric").agg(
        F.max(F.when(F.col(variant) == baseline, F.col("value"))).alias("baseline"),
        F.max(F.when(F.col(variant) == candidate, F.col("value"))).alias("candidate"),
    ).withColumn("delta", F.col("candidate") - F.col("baseline"))


def evaluation_summary(preds: DataFrame, by: Sequence[str] = ("model", "dataset")) -> DataFrame:
    """Long table (…, metric, class, value): accuracy, AUC, class report and averages.

    The predictions are read twice: once for all counts, once for the scores.
    """
    by = list(by)
    pairs = settle(_pairs(preds, by))
    report = _report(pairs, by)
    averages = _averages(report, by)
    none = F.lit(None).cast("string")

    def long(df: DataFrame, label: Column, names: Sequence[str]) -> DataFrame:
        rows = [
            F.struct(
                F.lit(n).alias("metric"), label.alias("class"), F.col(n).cast("double").alias("value")
            )
            for n in names
        ]
        return df.select(*by, F.inline(F.array(*rows)))

    shown = ("precision", "recall", "f1", "support")
    return (
        long(_binary(pairs, by), none, ["accuracy"])
        .unionByName(long(roc_auc(preds, by), none, ["auc"]))
        .unionByName(long(report, F.col("class").cast("string"), shown))
        .unionByName(long(averages, F.col("average"), shown))
    )


def diff_tables(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Cells that differ between two versions of a table, one row per key and column.

    A key found on one side only is reported for each column. Two missing values are equal.
    """
    left = a.select(F.col(key), F.struct(*columns).alias("_a"))
    right = b.select(F.col(key), F.struct(*columns).alias("_b"))
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"_a.{c}").cast("string").alias("before"),
            F.col(f"_b.{c}").cast("string").alias("after"),
            (F.col("_a").isNull() | F.col("_b").isNull()).alias("one_sided"),
        )
        for c in columns
    ]
    return (
        left.join(right, key, "full")
        .select(key, F.inline(F.array(*cells)))
        .where(F.col("one_sided") | ~F.col("before").eqNullSafe(F.col("after")))
    )
