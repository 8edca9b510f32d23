"""Weighted logistic regression, out-of-fold scores, tuning and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from labelaudit.operators.metrics import binary_metrics
from labelaudit.operators.profile import class_weights
from labelaudit.operators.split import fold_assignment
from labelaudit.session import store

TRIAL_METRICS = ("f1", "accuracy", "precision", "recall")


def as_features(df: DataFrame, vector: str) -> DataFrame:
    """Add ``features`` from an array column."""
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def fit_classifier(
    df: DataFrame,
    label: str = "label",
    weights: DataFrame | None = None,
    c: float = 1.0,
    max_iter: int = 1000,
    elastic_net: float = 0.0,
) -> LogisticRegressionModel:
    """Logistic regression with an L2 penalty of strength 1/c on unscaled features.

    MLlib divides the loss by the total weight and leaves the penalty whole, so
    the penalty is divided by the total weight to match a summed loss.
    ``weights`` is (label, weight), one row per class; a class without one is an error.
    """
    rows = df.where(F.col(label).isNotNull())
    options = {}
    total = F.count(F.lit(1)).cast("double")
    if weights is not None:
        # a row per class goes to every task; the features would else be brought together by class
        rows = rows.join(F.broadcast(weights.select(label, F.col("weight").alias("_w"))), label, "left")
        given = F.coalesce("_w", F.raise_error(F.lit("a class has no weight")).cast("double"))
        rows = rows.withColumn("weight", given).drop("_w")
        options["weightCol"] = "weight"
        total = F.sum("weight")
    n = rows.agg(total).first()[0] or 1.0
    model = LogisticRegression(
        featuresCol="features",
        labelCol=label,
        maxIter=max_iter,
        regParam=1.0 / (c * n),
        elasticNetParam=elastic_net,
        standardization=False,
        **options,
    )
    return model.fit(rows)


def score(df: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """Add ``p`` (class probabilities), ``probability`` of class 1 and ``predicted_label``."""
    scored = model.transform(df).withColumn("p", vector_to_array("probability"))
    return (
        scored.drop("rawPrediction", "probability")
        .withColumn("probability", F.get("p", F.lit(1)))
        .withColumn("predicted_label", F.col("prediction").cast("int"))
        .drop("prediction")
    )


def score_foreign(
    df: DataFrame,
    make_predict: Callable[[], Callable],
    column: str,
    classes: int = 2,
    batch_size: int = 16,
) -> DataFrame:
    """Score with a model from another library, loaded once per Python worker.

    ``make_predict`` returns a function from a batch of inputs to an array of
    ``classes`` probabilities per row. A missing text is scored as empty.
    """
    predict = predict_batch_udf(
        make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    shown = F.coalesce(F.col(column), F.lit("")) if df.schema[column].dataType == T.StringType() else F.col(column)
    return df.withColumn("p", predict(shown).cast("array<double>")).withColumn(
        "probability", F.get("p", F.lit(classes - 1))
    )


def out_of_fold(
    df: DataFrame,
    label: str = "label",
    k: int = 5,
    seed: int = 42,
    row_id: str = "row_id",
    weights: DataFrame | None = None,
    c: float = 1.0,
) -> DataFrame:
    """(row_id, label, fold, p): each row scored by a model that has not seen it.

    ``df`` holds ``row_id``, the label and ``features``, which are written once
    with their fold and read by every fit.
    """
    rows = df.select(row_id, label, "features").where(F.col(label).isNotNull())
    stored = store(rows.join(fold_assignment(rows, k, seed, row_id), row_id), "folds")
    parts = []
    for fold in range(k):
        model = fit_classifier(stored.where(F.col("fold") != fold), label, weights, c)
        held = score(stored.where(F.col("fold") == fold), model)
        parts.append(held.select(row_id, label, "fold", "p"))
    return reduce(DataFrame.unionByName, parts)


def fit_setting(train: DataFrame, params: Mapping, label: str, weights: DataFrame | None) -> LogisticRegressionModel:
    return fit_classifier(
        train,
        label,
        weights,
        c=params.get("c", 1.0),
        max_iter=int(params.get("max_iter", 100)),
        elastic_net=params.get("elastic_net", 0.0),
    )


def measured(model: LogisticRegressionModel, val: DataFrame, label: str) -> dict:
    preds = score(val.where(F.col(label).isNotNull()), model).withColumnRenamed(label, "true_label")
    row = binary_metrics(preds).first()
    return {m: row[m] for m in TRIAL_METRICS}


def run_trial(train: DataFrame, val: DataFrame, params: Mapping, label: str, weights: DataFrame | None) -> dict:
    return measured(fit_setting(train, params, label, weights), val, label)


def grid_search(
    train: DataFrame,
    val: DataFrame,
    grid: Sequence[Mapping],
    label: str = "label",
    weights: DataFrame | None = None,
    parallelism: int = 4,
    run: Callable[..., dict] = run_trial,
) -> DataFrame:
    """One row per setting with its metrics; a failed one has NaN and the error text.

    The fits share Spark through a few threads. The driver holds only the table
    of trials. ``weights`` defaults to balanced weights of ``train``.
    """
    spark = train.sparkSession
    weights = class_weights(train, label) if weights is None else weights

    def trial(numbered) -> dict:
        i, params = numbered
        try:
            return {"trial": i, **params, **run(train, val, params, label, weights), "error": None}
        except Exception as err:  # a failed trial must not end the search
            return {"trial": i, **params, **dict.fromkeys(TRIAL_METRICS, float("nan")), "error": str(err)[:500]}

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(trial, enumerate(grid, 1)))
    names = sorted({n for p in grid for n in p})
    schema = T.StructType(
        [T.StructField("trial", T.IntegerType())]
        + [T.StructField(n, T.DoubleType()) for n in [*names, *TRIAL_METRICS]]
        + [T.StructField("error", T.StringType())]
    )
    table = [
        tuple(float(r[f.name]) if f.dataType == T.DoubleType() and r.get(f.name) is not None else r.get(f.name)
              for f in schema)
        for r in rows
    ]
    return spark.createDataFrame(table, schema)


def refit_top(
    trials: DataFrame, train: DataFrame, val: DataFrame, k: int = 3, label: str = "label"
) -> tuple[list[LogisticRegressionModel], DataFrame]:
    """Fit the k best settings again: the models and a table of their metrics."""
    from labelaudit.operators.tracking import top_trials

    settings = [n for n in trials.columns if n not in ("trial", "error", *TRIAL_METRICS)]
    best = top_trials(trials.where("error IS NULL"), k).collect()  # k rows
    weights = class_weights(train, label)
    models = []

    def keep(train_, val_, params, label_, weights_):
        models.append(fit_setting(train_, params, label_, weights_))
        return measured(models[-1], val_, label_)

    grid = [{n: r[n] for n in settings if r[n] is not None} for r in best]
    table = grid_search(train, val, grid, label, weights, parallelism=1, run=keep)
    return models, table


def external_eval(df: DataFrame, model: LogisticRegressionModel, by: Sequence[str] = ()) -> DataFrame:
    """Class report of a model on a set from elsewhere (``features`` and ``true_label``)."""
    from labelaudit.operators.metrics import class_report

    return class_report(score(df, model), by)
