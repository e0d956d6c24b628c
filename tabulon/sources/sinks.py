"""Writers: processed splits, stage reports and session tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_splits(df: DataFrame, path: str) -> None:
    """One dataset per split under `path`, and nothing else."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark, path: str, split: str) -> DataFrame:
    """One split; the other ones are pruned before any file is opened."""
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def write_report(report: DataFrame, path: str) -> None:
    """A stage's report as JSON, one object per row; absent values are written as null."""
    lines = report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.mode("overwrite").text(path)


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest record of every key in both tables, by the `order` columns.

    An aggregation with map-side combine, not a window: a key with very many versions is reduced
    before it is shuffled.
    """
    both = existing.unionByName(incoming)
    latest = both.groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r"))
    return latest.select("r.*")
