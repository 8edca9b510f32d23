"""Training logs and tuning trials."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def _valid(metric: str):
    return F.col(metric).isNotNull() & ~F.isnan(metric)


def best_step(log: DataFrame, metric: str = "eval_f1", by: Sequence[str] = ()) -> DataFrame:
    """Step with the highest metric; the earlier step wins a tie, NaN never does."""
    return log.where(_valid(metric)).groupBy(*by).agg(
        F.max_by("step", F.struct(F.col(metric), -F.col("step"))).alias("best_step"),
        F.max(metric).alias("best_metric"),
    )


_THROUGHPUT = ("eval_runtime", "eval_samples_per_second", "eval_steps_per_second")


def log_throughput(
    log: DataFrame, columns: Sequence[str] = _THROUGHPUT, by: Sequence[str] = ()
) -> DataFrame:
    """Mean, min and max of the evaluation speed figures, one row per figure."""
    rows = [F.struct(F.lit(c).alias("figure"), F.col(c).alias("value")) for c in columns]
    return (
        log.select(*by, F.inline(F.array(*rows)))
        .where(F.col("value").isNotNull())
        .groupBy(*by, "figure")
        .agg(
            F.count("*").alias("n"),
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
        )
    )


def top_trials(trials: DataFrame, k: int = 3, metric: str = "f1", key: str = "trial") -> DataFrame:
    """The k best trials; failed ones (missing or NaN metric) come last, ties by ``key``."""
    usable = F.when(_valid(metric), F.col(metric))
    return trials.orderBy(usable.desc_nulls_last(), F.asc(key)).limit(k)


def best_trial(trials: DataFrame, metric: str = "f1", key: str = "trial") -> DataFrame:
    """The best trial, or no row when every trial failed."""
    return top_trials(trials.where(_valid(metric)), 1, metric, key)


def param_grid(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of the given values, numbered from 1 in the order of the axes."""
    one = spark.range(1).select(F.lit(0).alias("trial"))
    for name, values in axes.items():
        n = len(values)
        one = one.select(
            *[F.col(c) for c in one.columns if c != "trial"],
            "trial",
            F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_i", name),
        ).withColumn("trial", F.col("trial") * n + F.col("_i")).drop("_i")
    return one.select((F.col("trial") + 1).alias("trial"), *axes)
