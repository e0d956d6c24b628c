"""Profiles of growing tables: one small state per column and part, merged without reading the parts again.

A state has counts, mean and sum of squares about it, least and greatest value, a HyperLogLog sketch of
the distinct values and a KLL sketch of the distribution. Parts are whatever arrives together (a day, a
delivery); writing a part again replaces its states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabulon.functions.columns import long_aggregate, number, numeric_columns

#: About 1.6 % standard error of the distinct count, and 0.4 % of the rank of a quantile.
LOG_BUCKETS, KLL_K = 12, 800
QUANTILES = (0.25, 0.5, 0.75)


def column_states(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, rows, n, mean, squares, low, high, kinds, spread): the state of each numeric column, in one pass.

    NaN counts as missing, and -0.0 as 0.0. A column without values has null moments.
    """
    columns = list(columns or numeric_columns(df))
    value = lambda c: number(df, c) + F.lit(0.0)
    return long_aggregate(
        df, columns,
        {
            "rows": lambda c: F.count(F.lit(1)),
            "n": lambda c: F.count(value(c)),
            "mean": lambda c: F.avg(value(c)),
            "squares": lambda c: F.var_pop(value(c)) * F.count(value(c)),
            "low": lambda c: F.min(value(c)),
            "high": lambda c: F.max(value(c)),
            "kinds": lambda c: F.hll_sketch_agg(value(c).cast("string"), F.lit(LOG_BUCKETS)),
            "spread": lambda c: F.kll_sketch_agg_double(value(c), F.lit(KLL_K)),
        },
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One state per column from the states of any parts; merging merged states is the same."""
    some = F.col("n") > 0
    whole = F.sum("n")
    middle = F.try_divide(F.sum(F.when(some, F.col("n") * F.col("mean"))), whole)
    # Squares about the common mean: about the parts' own, and of the parts' means about it.
    totals = states.groupBy("column").agg(middle.alias("middle"))
    placed = states.join(F.broadcast(totals), "column")
    between = F.col("n") * (F.col("mean") - F.col("middle")) ** 2
    return placed.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        whole.alias("n"),
        F.first("middle").alias("mean"),
        F.sum(F.when(some, F.col("squares") + between)).alias("squares"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("kinds").alias("kinds"),
        F.kll_merge_agg_double(F.when(some, F.col("spread"))).alias("spread"),
    )


def summary_of(states: DataFrame) -> DataFrame:
    """(column, rows, missing, mean, std, min, max, distinct_count, q25, q50, q75) of merged states.

    Counts, moments and extremes are exact up to rounding; distinct counts and quartiles have the errors
    stated above. A column without values has null statistics and no distinct ones.
    """
    some = F.col("n") > 0
    quantile = lambda q: F.when(some, F.kll_sketch_get_quantile_double("spread", F.lit(q)))
    return states.select(
        "column", "rows", (F.col("rows") - F.col("n")).alias("missing"), "mean",
        F.sqrt(F.try_divide("squares", F.nullif(F.col("n") - 1, F.lit(0)))).alias("std"),
        F.col("low").alias("min"), F.col("high").alias("max"),
        F.when(some, F.hll_sketch_estimate("kinds")).otherwise(F.lit(0)).cast("long").alias("distinct_count"),
        *[quantile(q).alias(f"q{round(100 * q)}") for q in QUANTILES],
    )


def rank_of(states: DataFrame, value: Column) -> DataFrame:
    """(column, rank): the share of a column's values at or below `value`, from its merged state."""
    return states.select("column", F.when(F.col("n") > 0, F.kll_sketch_get_rank_double("spread", value)).alias("rank"))


def write_part(df: DataFrame, path: str, part: str, columns: Sequence[str] | None = None) -> None:
    """Keep the states of a part below `path`; the same part again takes the place of its earlier states."""
    column_states(df, columns).write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={part}")


def stored_profile(spark: SparkSession, path: str) -> DataFrame:
    """The summary of all parts below `path`; reads their states only."""
    return summary_of(merge_states(spark.read.parquet(path).drop("part")))
