"""A table with one row per key, in hash buckets, of which an update rewrites only those it touches.

An update goes in two steps: the new rows of the touched buckets are written next to the table, under
the update's id, and then take the place of the old ones. A run that ends in between is repeated with the
same id: complete new rows are put in place again instead of being made from a table that may have
changed half-way. So updates can be replayed, as a stream does after a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabulon.functions.columns import col

BUCKET = "bucket"
BUCKETS = 64


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def _with_bucket(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])


def latest_rows(key: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Merges rows of equal keys to the one that is last by the `order` columns."""

    def merge(rows: DataFrame) -> DataFrame:
        # An aggregation with map-side combine: a key with very many versions is reduced before the shuffle.
        last = F.max_by(F.struct(*[col(c) for c in rows.columns]), F.struct(*[col(c) for c in order]))
        return rows.groupBy(*[col(k) for k in key]).agg(last.alias("r")).select("r.*")

    return merge


def read_store(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All rows, one per key. A store nothing was written to yet is empty, if its `schema` is given."""
    try:
        reader = spark.read if schema is None else spark.read.schema(_with_bucket(schema))
        rows = reader.parquet(path)
    except AnalysisException:
        if schema is None:
            raise
        rows = spark.createDataFrame([], schema)
    return rows.drop(BUCKET)


def update_store(
    incoming: DataFrame,
    path: str,
    key: Sequence[str],
    merge: Callable[[DataFrame], DataFrame],
    update: int | str,
    buckets: int = BUCKETS,
) -> int:
    """Merge `incoming` into the store; returns the number of buckets that were rewritten.

    `merge` turns rows with repeated keys into one per key, and must not depend on their order or on how
    often it is applied. `update` names the update: the same name again puts the same rows in place.
    `buckets` has to stay the same for the life of a store. Null keys are a key like others.
    """
    spark = incoming.sparkSession
    pending = f"{path.rstrip('/')}-pending"
    mine = f"{pending}/update={update}"
    if not _exists(spark, f"{mine}/_SUCCESS"):
        where = F.pmod(F.xxhash64(*[col(k) for k in key]), F.lit(buckets)).cast("int")
        new = merge(incoming).withColumn(BUCKET, where)
        if _exists(spark, path):
            # At most `buckets` rows; only the touched folders are listed and read.
            touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
            old = spark.read.schema(_with_bucket(new.drop(BUCKET).schema)).parquet(path).where(F.col(BUCKET).isin(touched))
            new = merge(old.drop(BUCKET).unionByName(new.drop(BUCKET))).withColumn(BUCKET, where)
        # One task per bucket and so one file; a bucket holds 1/buckets of the keys, whatever their versions.
        new.repartition(buckets, BUCKET).write.mode("overwrite").parquet(mine)
    ready = spark.read.parquet(mine)
    ready.repartition(buckets, BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    files, folder = _file_system(spark, pending)
    for status in files.listStatus(folder):
        if status.getPath().getName() != f"update={update}":
            files.delete(status.getPath(), True)
    return ready.select(BUCKET).distinct().count()
