"""Readers and writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from labelaudit.sources.schemas import TRAINING_LOG


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, doubled quotes and line breaks inside fields.

    A record that does not fit the schema stops the read instead of shifting
    columns. Multi-line files are not splittable, so a large feed should be many
    files.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_split(spark: SparkSession, root: str, split: str, column: str = "split") -> DataFrame:
    """One named split of a table; on a table partitioned by it only its files are read."""
    return spark.read.parquet(root).where(F.col(column) == split).drop(column)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one with the same schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_table(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "errorifexists",
    partition_by: list[str] | None = None,
) -> None:
    """Write a folder of part files; CSV output reads back with :func:`read_csv`."""
    writer = df.write.mode(mode).format(format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.save(path)


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per log entry; fields an entry does not have are NULL."""
    return (
        spark.read.schema(TRAINING_LOG)
        .option("multiLine", True)
        .json(path)
        .select("best_metric", "best_model_checkpoint", F.explode("log_history").alias("entry"))
        .select("best_metric", "best_model_checkpoint", "entry.*")
    )
