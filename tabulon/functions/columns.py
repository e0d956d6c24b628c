"""Column classification and one-pass aggregation helpers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)

# Aggregate expressions handled by one pass. More are split by column, which keeps the generated
# code small enough to be compiled; each pass reads only its own columns, so a columnar file is
# still read once.
EXPRESSIONS_PER_PASS = 60


def family(dtype: T.DataType) -> str:
    """integral, floating, string, boolean, datetime or complex."""
    if isinstance(dtype, INTEGRAL):
        return "integral"
    if isinstance(dtype, FLOATING + (T.DecimalType,)):
        return "floating"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, DATETIME):
        return "datetime"
    return "complex"


def columns_of(df: DataFrame, *families: str) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) in families]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "integral", "floating")


def col(name: str) -> Column:
    """A column reference that takes the name literally, dots and all."""
    return F.col(f"`{name}`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so that null alone means missing."""
    c = col(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.when(~F.isnan(c), c)
    return c


def number(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def pearson(x: Column, y: Column) -> Column:
    """The correlation of two number columns over the rows that have both; null where one has a single value.

    The built-in aggregate divides by zero there.
    """
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.try_divide(F.covar_pop(x, y), spread)


def chunks(items: Sequence, size: int = EXPRESSIONS_PER_PASS) -> list[list]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def long_aggregate(
    df: DataFrame,
    columns: Sequence[str],
    metrics: Mapping[str, Callable[[str], Column]],
    fixed: Mapping[str, Callable[[str], str]] | None = None,
) -> DataFrame:
    """One row per column: `column`, the `fixed` texts, and every metric.

    Columns are aggregated together; the single result row is turned into rows afterwards. A
    metric must have the same type for every column.
    """
    frames = []
    for part in chunks(columns, max(1, EXPRESSIONS_PER_PASS // len(metrics))):
        flat = [
            make(name).alias(f"m{i}_{metric}")
            for i, name in enumerate(part)
            for metric, make in metrics.items()
        ]
        rows = F.array(
            *[
                F.struct(
                    F.lit(name).alias("column"),
                    *[F.lit(make(name)).alias(text) for text, make in (fixed or {}).items()],
                    *[F.col(f"m{i}_{metric}").alias(metric) for metric in metrics],
                )
                for i, name in enumerate(part)
            ]
        )
        frames.append(df.agg(*flat).select(F.inline(rows)))
    return union_all(frames)


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small fixed table as literals in the plan, so that no Python worker is involved."""
    fields = T.StructType.fromDDL(schema).fields
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))
