"""Constant and per-group predictions, the yardstick every candidate is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulon.functions.columns import col, number, present
from tabulon.operators.lookup import lookup


def _most_common(counts: DataFrame, *by: str):
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_y").alias("y")))
    return counts.groupBy(*by).agg(best["y"].alias("_pred"))


def baseline(train: DataFrame, df: DataFrame, target: str, task: str) -> DataFrame:
    """Add `prediction`: the train majority class (ties: smallest), or the train mean."""
    if task == "classification":
        counts = train.select(present(train, target).alias("_y")).where("_y is not null")
        value = _most_common(counts.groupBy("_y").agg(F.count("*").alias("_n"))).scalar()
    else:
        value = train.agg(F.avg(number(train, target)).alias("v")).scalar()
    return df.withColumn("prediction", value)


def group_baseline(train: DataFrame, df: DataFrame, group: str, target: str, task: str) -> DataFrame:
    """Add `prediction` per value of `group`; groups unseen in train get the overall baseline."""
    known = train.select(present(train, group).alias(group), present(train, target).alias("_y"))
    known = known.where(col(group).isNotNull() & F.col("_y").isNotNull())
    if task == "classification":
        table = _most_common(known.groupBy(group, "_y").agg(F.count("*").alias("_n")), group)
    else:
        table = known.groupBy(group).agg(F.avg("_y").alias("_pred"))
    out = lookup(baseline(train, df, target, task).withColumnRenamed("prediction", "_overall"), table, [group])
    return out.select(*[col(c) for c in df.columns], F.coalesce("_pred", "_overall").alias("prediction"))
