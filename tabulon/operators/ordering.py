"""Running totals, positions and previous rows that survive hot groups.

A window over `partitionBy(group)` puts the whole group into one task. These operators cut the
sorted data into range slices of similar size instead, work inside each slice, and carry one row
per slice across the boundaries. A group holding a third of all rows is thereby spread over a third
of the slices.

The order columns must identify a row within its group; aggregate duplicates first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tabulon.functions.columns import col
from tabulon.session import materialize

SLICE = "_slice"


def range_slices(df: DataFrame, order: Sequence[str], slices: int | None = None) -> DataFrame:
    """`df` cut into range slices by `order`, written out so that slice numbers stay fixed."""
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *[col(c) for c in order])
    return materialize(cut.withColumn(SLICE, F.spark_partition_id()), "slices")


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: dict[str, str],
    slices: int | None = None,
) -> DataFrame:
    """Add `totals` (new name -> amount column): the inclusive running sum within the group."""
    cut = range_slices(df, [*group, *order], slices)
    keys = [*group, SLICE]
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # At most one row per group and slice boundary: a group meets at most `n` slices.
    earlier = W.partitionBy(*group).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    per_slice = cut.groupBy(*keys).agg(*[F.sum(a).alias(a) for a in totals.values()])
    if group:
        # Only groups cut by a slice boundary have an offset; there are at most n - 1 of those.
        split = W.partitionBy(*group)
        per_slice = per_slice.withColumn("_parts", F.count("*").over(split)).where("_parts > 1")
    offsets = per_slice.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"_o_{t}") for t, a in totals.items()],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = cut.select("*", *[F.sum(a).over(inside).alias(f"_s_{t}") for t, a in totals.items()])
    return out.join(F.broadcast(offsets), same, "left").select(
        *df.columns,
        *[(F.col(f"_s_{t}") + F.coalesce(F.col(f"_o_{t}"), F.lit(0))).alias(t) for t in totals],
    )


def positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    slices: int | None = None,
) -> DataFrame:
    """Add the 1-based row number within the group (of the whole table for an empty group)."""
    return running_totals(
        df.withColumn("_one", F.lit(1).cast("long")), group, order, {name: "_one"}, slices
    ).drop("_one")


def previous_row(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    slices: int | None = None,
) -> DataFrame:
    """Add `values` (new name -> column): the column's value in the group's preceding row."""
    cut = range_slices(df, [*group, *order], slices)
    record = F.struct(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                      *[F.col(c).alias(n) for n, c in values.items()])
    inside = W.partitionBy(SLICE).orderBy(*group, *order)
    # One row per slice.
    tails = cut.groupBy(SLICE).agg(
        F.max_by(record, F.struct(*group, *order)).alias("_tail")
    )
    carry = tails.select(F.col(SLICE), F.lag("_tail").over(W.orderBy(SLICE)).alias("_carry"))
    before = F.coalesce(F.lag(record).over(inside), F.col("_carry"))
    out = cut.join(F.broadcast(carry), SLICE).withColumn("_before", before)
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_before._g{i}"))
    return out.select(
        *df.columns, *[F.when(same, F.col(f"_before.{n}")).alias(n) for n in values]
    )
