"""Rendering any value as JSON of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The limits of a rendered report and the notes on what was cut.
MAX_ITEMS = 15
MAX_TEXT = 300
MAX_CHARS = 6000
OMITTED = "__omitted__"
CUT_NOTE = "... [truncated, %d chars total]"
ITEMS_NOTE = "... %d more items omitted"
KEYS_NOTE = "%d more keys omitted"


def cut_text(text: Column, limit: int = MAX_TEXT) -> Column:
    """A text of at most `limit` characters, followed by its full length when it was cut."""
    cut = F.concat(F.left(text, F.lit(limit)), F.format_string(CUT_NOTE, F.length(text)))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def _json(value: Column, dtype: T.DataType, items: int, chars: int) -> Column:
    """JSON text of a value with every list, map, struct and string cut to the limits."""
    quote = lambda t: F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2)
    if isinstance(dtype, T.StringType):
        out = quote(cut_text(value, chars))
    elif isinstance(dtype, T.ArrayType):
        parts = F.transform(F.slice(value, 1, items), lambda v: _json(v, dtype.elementType, items, chars))
        more = F.size(value) - items
        note = F.format_string(f'"{ITEMS_NOTE}"', more)
        out = _enclose("[", F.when(more > 0, F.array_append(parts, note)).otherwise(parts), "]")
    elif isinstance(dtype, T.MapType):
        entries = F.map_entries(value)
        parts = F.transform(
            F.slice(entries, 1, items),
            lambda e: F.concat(quote(e["key"].cast("string")), F.lit(":"), _json(e["value"], dtype.valueType, items, chars)),
        )
        more = F.size(entries) - items
        note = F.format_string(f'"{OMITTED}":"{KEYS_NOTE}"', more)
        out = _enclose("{", F.when(more > 0, F.array_append(parts, note)).otherwise(parts), "}")
    elif isinstance(dtype, T.StructType):
        parts = [
            F.concat(quote(F.lit(f.name)), F.lit(":"), _json(value[f.name], f.dataType, items, chars))
            for f in dtype.fields[:items]
        ]
        if len(dtype.fields) > items:
            parts.append(F.lit(f'"{OMITTED}":"{KEYS_NOTE % (len(dtype.fields) - items)}"'))
        out = _enclose("{", F.array(*parts), "}")
    elif isinstance(dtype, (T.BooleanType, T.IntegralType)):
        out = value.cast("string")
    elif isinstance(dtype, (T.FractionalType, T.VariantType)):
        text = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        out = text.substr(F.lit(6), F.length(text) - 6)
    else:
        out = quote(value.cast("string"))
    return F.coalesce(out, F.lit("null"))


def _enclose(left: str, parts: Column, right: str) -> Column:
    return F.concat(F.lit(left), F.array_join(parts, ","), F.lit(right))


def bounded_json(df: DataFrame, column: str, items: int = MAX_ITEMS, chars: int = MAX_TEXT) -> Column:
    """The column as JSON with every part cut to the limits; follows the column's schema."""
    return _json(F.col(f"`{column}`"), df.schema[column].dataType, items, chars)


def render(
    df: DataFrame, column: str, items: int = MAX_ITEMS, chars: int = MAX_TEXT, total: int = MAX_CHARS
) -> DataFrame:
    """Add `rendered` and `is_truncated`: bounded JSON, cut as a whole at `total` characters."""
    text = bounded_json(df, column, items, chars)
    note = F.format_string("\n" + CUT_NOTE, F.length("_text"))
    over = F.length("_text") > total
    return (
        df.withColumn("_text", text)
        .withColumn("rendered", F.when(over, F.concat(F.left("_text", F.lit(total)), note)).otherwise(F.col("_text")))
        .withColumn("is_truncated", over)
        .drop("_text")
    )
