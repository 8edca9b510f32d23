"""Snapshots of a review ledger: the latest decision per text, and what came after.

A ledger only grows, and every reader would group all of it. A snapshot holds one decision
per text as of a set of ledger files; a manifest names the snapshot and those files. Readers
take the newest manifest, its snapshot, and the ledger files it does not name. Making a
snapshot is two writes: the snapshot to a folder of its own, then the manifest, which is the
switch. A program that ends between the two leaves a folder nobody reads, and loses nothing;
of two at once the one that switches last counts, and what the other had folded is tail again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from labelaudit.functions.expressions import text_key
from labelaudit.operators.review import read_ledger
from labelaudit.sources.schemas import REVIEWED
from labelaudit.sources.tables import read_or_empty

MANIFEST = T.StructType(
    [T.StructField("version", T.LongType()), T.StructField("snapshot", T.StringType()), T.StructField("file", T.StringType())]
)


def newest_per_text(reviewed: DataFrame) -> DataFrame:
    """The latest decision of each text, whole; of the same time the one with the larger label."""
    columns = reviewed.columns
    rest = [c for c in columns if c not in ("review_date", "final_label")]
    newest = F.max(F.struct("review_date", "final_label", *rest)).alias("_d")
    rows = reviewed.where(F.col("text").isNotNull()).groupBy(text_key("text").alias("_k")).agg(newest)
    return rows.select(*[F.col(f"_d.{c}").alias(c) for c in columns])


def current(spark: SparkSession, root: str) -> tuple[int, str | None, set[str]]:
    """Version, snapshot and folded files of the newest manifest: a row per ledger file."""
    rows = read_or_empty(spark, f"{root}/manifests", MANIFEST)
    last = rows.agg(F.max(F.struct("version", "snapshot"))).first()[0]
    if last is None:
        return 0, None, set()
    mine = rows.where((F.col("version") == last["version"]) & (F.col("snapshot") == last["snapshot"]))
    return last["version"], last["snapshot"], {r["file"] for r in mine.select("file").collect()}


def _parts(spark: SparkSession, ledger: str, root: str) -> tuple[int, set[str], DataFrame]:
    version, snapshot, folded = current(spark, root)
    files = set(read_ledger(spark, ledger).inputFiles())
    tail = sorted(files - folded)
    parts = [spark.read.schema(REVIEWED).parquet(f"{root}/{snapshot}")] if snapshot else []
    parts += [spark.read.schema(REVIEWED).parquet(*tail)] if tail else []
    empty = spark.createDataFrame([], REVIEWED)
    return version, files | folded, parts[0].unionByName(parts[1]) if len(parts) == 2 else (parts or [empty])[0]


def newest_decisions(spark: SparkSession, ledger: str, root: str) -> DataFrame:
    """The latest decision of each text of the ledger, from the newest snapshot and the files after it."""
    return newest_per_text(_parts(spark, ledger, root)[2])


def compact(spark: SparkSession, ledger: str, root: str) -> int:
    """Fold all ledger files into a new snapshot under ``root``; returns its version."""
    version, files, rows = _parts(spark, ledger, root)
    name = f"snapshots/{version + 1}-{uuid.uuid4().hex}"
    newest_per_text(rows).write.parquet(f"{root}/{name}")
    switch(spark, root, version + 1, name, files)
    return version + 1


def switch(spark: SparkSession, root: str, version: int, snapshot: str, files: set[str]) -> None:
    """Make a snapshot the one that counts: its manifest appears whole or not at all, as one file."""
    rows = [(version, snapshot, f) for f in sorted(files)] or [(version, snapshot, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifests")
