"""From raw documents to training sequences, in stages that each write their result as a table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.llm import line_dedup, ngram_join, packing, pii, quality
from tabulon.llm.common import stored
from tabulon.llm.queries import train_rows
from tabulon.plans.catalog import table
from tabulon.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the number of characters of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score is one half or more; nothing else about them changes.

    A null text is scored like an empty one, repeated rows are scored alike. Columns other than those of
    documents are dropped, here and in the stages that follow.
    """
    ship_package(spark)
    rows = train_rows(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), "quality", 3, 1)
    model = quality.fit(stored(quality.with_statistics(rows).select("label", "statistics"), "labelled"))
    return quality.with_scores(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines; every document stays, if need be with an empty text."""
    return _documents(line_dedup.drop_boilerplate(docs.select(*COLUMNS)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, and all that have no words."""
    ship_package(spark)
    return ngram_join.drop_near_duplicates(docs.select(*COLUMNS))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets by their kind; every document stays and a null text stays null."""
    ship_package(spark)
    found = pii.with_personal_data(docs.select(*COLUMNS))
    return _documents(found.withColumn("text", F.when(F.col("text").isNotNull(), F.col("masked"))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its place.

    A null text is packed like an empty one, as its end token; each of repeated rows is packed.
    """
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: The decoding of a conditional random field and bounded-space packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
