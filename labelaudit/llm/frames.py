"""What the operators share: hidden input columns, and texts as Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names no operator uses, and the new name of each old one.

    Operators add columns of their own; like this, a column of the input that
    happens to have the same name neither clashes nor is overwritten.
    """
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def shown(df: DataFrame, names: dict[str, str], *more) -> DataFrame:
    """The input columns under their own names, then ``more``, which replaces equal names."""
    added = df.select(*more).columns
    return df.select(*[df[new].alias(old) for old, new in names.items() if old not in added], *more)


def slices(batch: pa.RecordBatch, column: int = -1, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of the given text column, so that what is made of it stays small."""
    lengths = pc.fill_null(pc.binary_length(batch.columns[column]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a missing text is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def made_of(
    text: Column, added: str, fn: Callable[[list[bytes]], dict[str, list]], done: Callable[[], None] | None = None
) -> Column:
    """A struct of the columns ``added`` that ``fn`` makes of the text.

    Only the text goes to Python, and only what is made of it comes back: for wide rows.
    Declared as not deterministic, so that no filter on it makes the plan evaluate it twice.
    ``done`` is called at the end of a partition, to free what later stages don't need, as
    Python workers live on.
    """
    struct = T.StructType.fromDDL(added)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(struct)
        for texts in batches:
            parts = []
            for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
                made = fn(text_bytes(part.column(0)))
                parts.append(pa.StructArray.from_arrays([pa.array(made[f.name], f.type) for f in kind], fields=list(kind)))
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)
        if done is not None:
            done()

    return F.arrow_udf(run, struct).asNondeterministic()(text)


def map_texts(
    docs: DataFrame,
    text: str,
    keep: Sequence[str],
    added: str,
    fn: Callable[[list[bytes]], dict[str, list]],
    size: int = 4 << 20,
) -> DataFrame:
    """``keep`` columns of ``docs`` and the columns ``added`` that ``fn`` makes of the texts.

    ``fn`` gets the UTF-8 bytes of a slice of about ``size`` bytes of an Arrow batch and returns a list per column.
    Only the kept columns and the text go through Python: keep few, or use :func:`made_of`.
    """
    rows = docs.select(*[docs[c] for c in keep], docs[text])
    types = T.StructType.fromDDL(added).fields
    kept = rows.schema.fields[:-1]
    schema = T.StructType([T.StructField(f"_c{i}", f.dataType) for i, f in enumerate([*kept, *types])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in (part for whole in batches for part in slices(whole, size=size)):
            made = fn(text_bytes(batch.columns[-1]))
            columns = batch.columns[:-1]
            columns += [pa.array(made[f.name], arrow.field(len(kept) + i).type) for i, f in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.toDF(*schema.names[: len(kept)], "_text").mapInArrow(run, schema).toDF(*keep, *[f.name for f in types])
