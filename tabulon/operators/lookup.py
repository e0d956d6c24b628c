"""Joining rows to a fitted table that has one row per key.

A small table is broadcast after its size has been measured. A larger one is joined by shuffle,
with the hot keys taken out first and broadcast on their own: at most 1/HOT_SHARE keys can be hot,
so that side is bounded whatever the data looks like.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F, types as T

from tabulon.session import materialize

BROADCAST_BYTES = 64 << 20
HOT_SHARE = 0.001


def row_bytes(table: DataFrame):
    """About the bytes of a row of `table` in memory, as an expression."""
    width = F.lit(8 * len(table.columns))
    for f in table.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif not isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.DatetimeType)):
            width = width + F.octet_length(F.to_json(F.struct(f"`{f.name}`")))
    return width


def fits_broadcast(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of `table`, measured, stay below `limit` bytes."""
    size = table.agg(F.coalesce(F.sum(row_bytes(table)), F.lit(0))).first()[0]
    return size <= limit


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    limit: int = BROADCAST_BYTES,
    stored: bool = False,
) -> DataFrame:
    """Left join of `df` with `table`, whose `keys` are unique; missing keys give nulls.

    `table` is written out first unless the caller says it is `stored` already, so that measuring
    it and joining it do not compute it twice.
    """
    table = table if stored else materialize(table, "lookup")
    if fits_broadcast(table, limit):
        return df.join(F.broadcast(table), list(keys), "left")

    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    counted = materialize(df.where(known).groupBy(*keys).agg(F.count("*").alias("_n")), "keys")
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = counted.where(F.col("_n") > total * HOT_SHARE).select(*keys)
    hot_table = hot.join(table, list(keys), "left")
    added = [c for c in table.columns if c not in keys]
    columns = [*df.columns, *added]
    keyed = df.where(known)
    frames = [
        keyed.join(F.broadcast(hot_table), list(keys)).select(*columns),
        keyed.join(F.broadcast(hot), list(keys), "left_anti")
        .join(table.hint("merge"), list(keys), "left")
        .select(*columns),
        df.where(~known).select(
            *df.columns, *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in added]
        ),
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def lookup_counted(df: DataFrame, table: DataFrame, key: str, count: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` joined with `table`, which has every `key` of `df` once and tells in `count` how many rows of `df` have it.

    The most frequent keys are broadcast, as many as stay below `limit` bytes, and with them the join of most rows.
    Only rows of rarer keys are shuffled. Both inputs are stored.
    """
    # Keys are taken by the size of their count, four steps to a doubling: at most 256 rows reach the driver.
    step = F.floor(F.log2(count) * 4)
    sizes = table.groupBy(step.alias("step")).agg(F.sum(row_bytes(table)).alias("bytes")).orderBy(F.desc("step")).collect()
    columns = [*df.columns, *[c for c in table.columns if c != key]]
    total, least = 0, None
    for r in sizes:
        total += r["bytes"]
        if total > limit:
            break
        least = r["step"]
    if total <= limit:
        return df.join(F.broadcast(table), key).select(*columns)
    if least is None:
        return df.join(table.hint("merge"), key).select(*columns)
    common, rare = table.where(step >= least), table.where(step < least)
    left = df.join(F.broadcast(common.select(key)), key, "left_anti")
    frames = [df.join(F.broadcast(common), key), left.join(rare.hint("merge"), key)]
    return frames[0].select(*columns).unionByName(frames[1].select(*columns))
