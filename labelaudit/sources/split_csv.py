"""CSV with line breaks inside fields, read in parallel within a file.

A line break ends a record if the quotes before it, from the start of the file, are even
in number (doubled quotes count twice). Quotes are counted per byte range of each file,
the counts of the ranges before are added up, and then every range knows whether it begins
inside a field. Records that begin and end in a range are complete; the lines at a range's
ends that belong to a record across its border are put together by file and record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from labelaudit.session import store

_OPTIONS = {
    "quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}
#: ``kind``: 0 a whole record, 1 the begin of one, 2 the rest of one that began earlier, and maybe goes on.
_PIECES = "file string, start long, nr long, kind int, line string"


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the byte range that they begin in; ranges are the session's ``spark.sql.files.maxPartitionBytes``."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _cut(lines: DataFrame) -> DataFrame:
    """Pieces of records of each range, given whether it begins inside a field (``odd``)."""
    columns = ["file", "start", "odd", "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("nr", pa.int64()), ("kind", pa.int32()), ("line", pa.string())])
        at = inside = None
        held: list[str] = []  # lines of the record that is open
        kind = nr = 0
        out: list[tuple] = []
        for batch in batches:
            for file, start, odd, line in zip(*[batch.column(c).to_pylist() for c in columns]):
                if at != (file, start):
                    if held:
                        out.append((*at, nr, kind if kind == 2 else 1, "\n".join(held)))
                    at, inside, held, nr, kind = (file, start), bool(odd), [], 0, 2 if odd else 0
                held.append(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    out.append((*at, nr, kind, "\n".join(held)))
                    held, nr, kind = [], nr + 1, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if held:
            out.append((*at, nr, kind if kind == 2 else 1, "\n".join(held)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return lines.select(*columns).mapInArrow(run, _PIECES)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, nr, line): every record as one string; ``start`` and ``nr`` give their order in a file."""
    lines = _lines(spark, path)
    counts = lines.groupBy("file", "start").agg((F.sum(_quotes(F.col("line"))) % 2).alias("_q"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # a row per byte range
    ranges = store(counts.select("file", "start", (F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2).alias("odd")), "ranges")
    pieces = store(_cut(lines.join(F.broadcast(ranges), ["file", "start"])), "pieces")
    # two rows per byte range at most: a record begins in one, and goes on in those after it
    ends = pieces.where("kind > 0")
    order = Window.partitionBy("file").orderBy("start", "nr")
    ends = ends.withColumn("_r", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(order))
    joined = ends.groupBy("file", "_r").agg(F.array_sort(F.collect_list(F.struct("start", "nr", "line"))).alias("_l"))
    joined = joined.select(
        "file", F.col("_l")[0]["start"].alias("start"), F.col("_l")[0]["nr"].alias("nr"),
        F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("line"),
    )
    return pieces.where("kind = 0").drop("kind").unionByName(joined)


def read_csv_parallel(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of :func:`sources.tables.read_csv`, a file being as many tasks as it has byte ranges.

    Each file begins with the header, whose names must be those of ``schema`` in order.
    Empty lines between records are no records. A record that does not fit stops the read.
    """
    records = read_records(spark, path)
    line = F.regexp_replace("line", "\r$", "")
    is_header = (F.col("start") == 0) & (F.col("nr") == 0)
    names = F.regexp_replace(F.regexp_replace(line, '^﻿', ""), '"', "")
    expected = ",".join(f.name for f in schema)
    wrong = F.raise_error(F.concat(F.lit(f"the header is not {expected}, but "), names)).cast("boolean")
    rows = records.where(F.when(is_header, F.when(names == expected, False).otherwise(wrong)).otherwise(line != ""))
    return rows.select(F.from_csv(line, _ddl(schema), _OPTIONS).alias("_row")).select("_row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
