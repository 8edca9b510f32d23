"""Session helpers: time zone and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on. Works on the given session, builds none."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own, which goes
    when the program ends. A cluster without one, or with one on a single machine,
    is a configuration error, since such a folder is lost with its machine.
    """
    context = spark.sparkContext
    local = context.master.startswith("local")
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not local and (folder is None or folder.startswith("file:")):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if folder is None:
        folder = tempfile.mkdtemp(prefix="labelaudit-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the shared folder, and go on from there.

    Cuts the lineage and fixes values that are not repeatable across runs of a
    plan, such as partition numbers. A lost executor costs a re-read. Meant for
    narrow rows, all of whose columns are used afterwards.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`settle` for wide rows: as Parquet, so later readers prune columns."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
