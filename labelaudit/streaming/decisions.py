"""Review decisions arriving as files, appended to the same ledger as the batch path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from labelaudit.operators.review import conform_decisions
from labelaudit.sources.schemas import RAW_DECISIONS, REVIEWED

def read_decisions(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(RAW_DECISIONS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def without_redelivery(decisions: DataFrame, delay: str) -> DataFrame:
    """Drop repeats of the same delivery that arrive within ``delay`` of each other.

    The state is bounded by the watermark. A delivery older than the watermark
    is dropped by Spark, so use this only where ``delay`` covers every delivery;
    the ledger needs it only to stay small, because reading it keeps the latest
    decision per text anyway.
    """
    same = F.sha2(F.to_json(F.struct(*decisions.columns)), 256)
    return (
        decisions.withColumn("_k", same)
        .withWatermark("review_date", delay)
        .dropDuplicatesWithinWatermark(["_k"])
        .drop("_k")
    )


def stream_decisions(
    spark: SparkSession,
    folder: str,
    ledger: str,
    rejects: str,
    progress: str,
    delay: str | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process every file now in ``folder``, then stop.

    Each micro-batch writes its own partition, named by the query's id, which lives in
    ``progress``, and the batch, in overwrite mode: a batch that is run again after a
    failure replaces its rows instead of adding them twice, and a new ``progress`` folder
    never touches what an older one wrote. ``progress`` is the stream's checkpoint folder;
    it must be shared. Invalid decisions go to ``rejects`` with their reason.
    """
    raw = read_decisions(spark, folder, files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        good, bad = conform_decisions(batch)
        good.write.mode("overwrite").parquet(f"{ledger}/run={run}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{rejects}/run={run}/batch={batch_id}")

    stream = raw if delay is None else without_redelivery(raw, delay)
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )


def read_streamed_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(REVIEWED).option("basePath", ledger).parquet(ledger)
