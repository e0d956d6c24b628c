"""Train / validation / test splits that do not depend on how the data is partitioned."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulon.functions.columns import col
from tabulon.operators.lookup import fits_broadcast, lookup
from tabulon.session import materialize

PERCENT = {"train": 70, "validation": 15, "test": 15}


def hash_bucket(key: Column, salt: str = "") -> Column:
    """A stable bucket 0..99 of the key: the first 32 bits of its md5, modulo 100."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def _cuts(percent: Mapping[str, int]) -> list[int]:
    if sum(percent.values()) != 100:
        raise ValueError("split percentages must add up to 100")
    cuts, upto = [], 0
    for share in percent.values():
        upto += share
        cuts.append(upto)
    return cuts


def hash_split(
    df: DataFrame, key: str, percent: Mapping[str, int] = PERCENT, salt: str = ""
) -> DataFrame:
    """Add `split`, decided row by row from the key: no shuffle, and stable under repartitioning."""
    bucket, names, cuts = hash_bucket(col(key), salt), list(percent), _cuts(percent)
    split = F.lit(names[-1])
    for name, cut in reversed(list(zip(names[:-1], cuts[:-1]))):
        split = F.when(bucket < cut, F.lit(name)).otherwise(split)
    return df.withColumn("split", split)


def stratified_split(
    df: DataFrame, target: str, key: str, percent: Mapping[str, int] = PERCENT
) -> DataFrame:
    """Add `split` with the same shares inside every class, in the order of md5(key).

    Equal to ranking each class by md5(key) and cutting the ranks, but no class is sorted: the
    digests' leading digits are counted per class, which shows the slice (1 in 65,536 of the class)
    each cut falls into; only those slices are ranked, and every row is then compared with its
    class's cut digest. Rows with the same key stay together. Rows without a class get no split.
    """
    names, cuts = list(percent), _cuts(percent)[:-1]
    digest = F.md5(col(key).cast("string"))
    keyed = df.select(col(target).alias("y"), digest.alias("h")).where("y is not null")
    head = F.substring("h", 1, 4)
    in_class = W.partitionBy("y")
    counted = keyed.groupBy("y", head.alias("s")).count()
    placed = counted.select(
        "y",
        "s",
        (F.sum("count").over(in_class.orderBy("s")) - F.col("count")).alias("before"),
        F.sum("count").over(in_class.orderBy("s")).alias("upto"),
        F.sum("count").over(in_class).alias("n"),
    )
    keep = [F.struct(F.lit(i).alias("cut"), F.expr(f"n * {c} div 100").alias("keep")) for i, c in enumerate(cuts)]
    wanted = materialize(
        placed.select("*", F.inline(F.array(*keep))).where("before <= keep and keep < upto"), "cuts"
    )
    side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    near = (
        keyed.select("y", "h", head.alias("s"))
        .join(side, ["y", "s"])
        .groupBy("y", "cut", "s", "before", "keep", "h")
        .count()
    )
    end = F.col("before") + F.sum("count").over(W.partitionBy("y", "cut").orderBy("h"))
    last = (
        near.withColumn("end", end)
        .groupBy("y", "cut")
        .agg(F.coalesce(F.max(F.when(F.col("end") <= F.col("keep"), F.col("h"))), F.first("s")).alias("at"))
    )
    # "g" lies above every hexadecimal digest: the whole class is kept.
    per_class = last.groupBy(F.col("y").alias(target)).agg(
        *[
            F.coalesce(F.max(F.when(F.col("cut") == i, F.col("at"))), F.lit("g")).alias(f"_cut{i}")
            for i in range(len(cuts))
        ]
    )
    split = F.lit(names[-1])
    for i in reversed(range(len(cuts))):
        split = F.when(digest <= F.coalesce(F.col(f"_cut{i}"), F.lit("g")), F.lit(names[i])).otherwise(split)
    return lookup(df, per_class, [target]).select(
        *[col(c) for c in df.columns], F.when(col(target).isNotNull(), split).alias("split")
    )
