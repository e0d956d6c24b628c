"""Dataset readers by type, and document readers that tolerate broken files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabulon.sources.workbooks import parse_workbooks

CORRUPT = "_corrupt_record"


def read_table(
    spark: SparkSession, path: str, kind: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Read a dataset of kind csv, parquet, excel, text, images or json.

    CSV: first line is the header; with a schema, malformed rows are kept in `_corrupt_record`
    (asked for by adding that column), without one it is inferred. Excel: first sheet of every
    workbook under `path`, first row is the header, all values as strings unless a schema is given.
    Images: path, size and modification time only; the files' contents are not read.
    """
    if kind == "csv":
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        if schema is None:
            return reader.option("inferSchema", True).csv(path)
        return reader.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    if kind == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if kind == "text":
        return spark.read.text(path)
    if kind == "images":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return files.select("path", "length", "modificationTime")
    if kind == "json":
        return spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)
    if kind == "excel":
        books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
        return parse_workbooks(books.select("path", "content"), schema)
    raise ValueError(f"unsupported dataset type {kind!r}")


# Dataset types and the file endings that imply them.
ENDINGS = {".csv": "csv", ".parquet": "parquet", ".xlsx": "excel", ".txt": "text", ".json": "json"}


def load_dataset(
    spark: SparkSession, info: Mapping, base: str = "", schema: T.StructType | str | None = None
) -> DataFrame:
    """The dataset a task record points to; relative paths are resolved against `base` once."""
    path = info.get("data_path")
    if not path:
        raise ValueError("the task record has no data_path")
    if base and "://" not in path and not path.startswith("/"):
        path = f"{base.rstrip('/')}/{path}"
    kind = info.get("data_type") or next(
        (kind for ending, kind in ENDINGS.items() if path.lower().endswith(ending)), None
    )
    if kind is None:
        raise ValueError(f"no dataset type given for {path}")
    return read_table(spark, path, kind.lower(), schema)


def parse_documents(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """Add `doc` (parsed by `schema`, null when malformed) and `is_valid`. Blank text is not valid."""
    whole = F.col(column)
    valid = F.try_parse_json(whole).isNotNull() & whole.rlike(r"\S")
    return texts.select("*", F.when(valid, F.from_json(whole, schema)).alias("doc"), F.coalesce(valid, F.lit(False)).alias("is_valid"))


def read_documents(spark: SparkSession, path: str, schema: str, whole_files: bool = True) -> DataFrame:
    """JSON documents as rows of `path, value, doc, is_valid`: one per file, or one per line.

    No file means no documents.
    """
    try:
        texts = spark.read.text(path, wholetext=whole_files)
        named = texts.select(F.col("_metadata.file_path").alias("path"), "value")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        named = spark.createDataFrame([], "path string, value string")
    return parse_documents(named, "value", schema)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """`path, length` of every file below `path`; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")
