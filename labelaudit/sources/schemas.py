"""Explicit schemas and column checks; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
}


def fields(**types: str) -> T.StructType:
    """A schema from ``name="type"`` pairs; needs no running session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in types.items()])


REVIEWED = fields(
    text="string",
    category="string",
    given_label="int",
    suggested_label="int",
    final_label="int",
    review_date="timestamp",
    reviewer_notes="string",
)
RAW_DECISIONS = fields(
    text="string",
    category="string",
    given_label="int",
    suggested_label="int",
    answer="string",
    new_label="string",
    reviewer_notes="string",
    review_date="timestamp",
)
PREDICTIONS = fields(
    text="string", true_label="int", predicted_label="int", probability="double"
)
LOG_ENTRY = fields(
    epoch="double",
    step="bigint",
    loss="double",
    grad_norm="double",
    learning_rate="double",
    eval_accuracy="double",
    eval_f1="double",
    eval_loss="double",
    eval_precision="double",
    eval_recall="double",
    eval_runtime="double",
    eval_samples_per_second="double",
    eval_steps_per_second="double",
)
TRAINING_LOG = T.StructType(
    [
        T.StructField("best_metric", T.DoubleType()),
        T.StructField("best_model_checkpoint", T.StringType()),
        T.StructField("log_history", T.ArrayType(LOG_ENTRY)),
    ]
)

# Accepted spellings of the two column names every table needs.
COLUMN_ALIASES = {"lable": "label", "text": "content", "example": "content"}


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail before any job starts when a column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def normalize_columns(df: DataFrame, aliases: dict[str, str] = COLUMN_ALIASES) -> DataFrame:
    """Rename accepted spellings; a name already in use is left alone."""
    taken, renames = set(df.columns), {}
    for old, new in aliases.items():
        if old in df.columns and new not in taken:
            renames[old] = new
            taken.add(new)
    return df.withColumnsRenamed(renames)


def _convert(name: str, source: T.DataType, target: T.DataType):
    c = F.col(f"`{name}`")
    if isinstance(target, T.IntegerType) and isinstance(source, T.StringType):
        # labels stored as "1.0" by a writer that knows only floats; "1.7" is no label
        real = c.try_cast("double")
        return F.coalesce(F.when(~c.contains("."), c.try_cast("int")), F.when(real == F.floor(real), real.try_cast("int")))
    if isinstance(source, (T.FloatType, T.DoubleType)):
        c = F.when(~F.isnan(c), c)
    return c.try_cast(target)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and convert to ``schema``; a value that does not fit becomes missing."""
    require_columns(df, schema.fieldNames())
    return df.select(
        *[_convert(f.name, df.schema[f.name].dataType, f.dataType).alias(f.name) for f in schema]
    )


def conform_losses(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per column: present before, and lost by the conversion."""
    require_columns(df, schema.fieldNames())
    sums, stacked = [], []
    for f in schema:
        before = F.col(f"`{f.name}`")
        after = _convert(f.name, df.schema[f.name].dataType, f.dataType)
        sums += [
            F.count(before).alias(f"{f.name}__n"),
            F.count_if(before.isNotNull() & after.isNull()).alias(f"{f.name}__lost"),
        ]
        stacked.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.col(f"`{f.name}__n`").alias("n_present"),
                F.col(f"`{f.name}__lost`").alias("n_lost"),
            )
        )
    return df.agg(*sums).select(F.inline(F.array(*stacked)))
