"""Boilerplate lines by site-relative frequency, with DataFrame functions only.

A line is boilerplate on a host when it is on more than `max_ratio` of the host's pages, and on at
least `min_pages` of them, so that the lines of a host with a handful of pages are not taken for
boilerplate. Those lines are removed from the host's pages. Pages of a host with the same text count
as one, in both numbers, so that a page that was stored many times is not taken for boilerplate.

Each page contributes each of its lines once, as a digest, and counts are combined before the
shuffle, so a host with a third of all pages costs no more than its own share. A host has at most
(lines per page) / `max_ratio` boilerplate lines; they come back to the pages as one array per host,
broadcast only when the measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.operators.lookup import fits_broadcast
from tabulon.llm.common import free_name, stored

BROADCAST_BYTES = 16 << 20


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def digest(line: Column) -> Column:
    """16 bytes that stand for a line; blanks at its ends do not count."""
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 5
) -> DataFrame:
    """(host, digest, pages, host_pages) of every boilerplate line; blank lines are never counted."""
    lines = F.array_distinct(F.transform(F.filter(lines_of(F.col(text)), lambda x: F.trim(x) != ""), digest))
    pages = (
        docs.select(F.col(host).alias("host"), F.unhex(F.md5(F.col(text).cast("binary"))).alias("page"), lines.alias("lines"))
        .groupBy("host", "page")
        .agg(F.first("lines").alias("lines"))
    )
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = (
        pages.select("host", F.explode("lines").alias("digest"))
        .groupBy("host", "digest")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    same = counts["host"].eqNullSafe(totals["host"])
    return counts.join(totals, same).select(counts["host"], "digest", "pages", "host_pages").where(
        F.col("pages") > F.col("host_pages") * max_ratio
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, min_pages: int = 5
) -> DataFrame:
    """`docs`, all rows and columns, with boilerplate lines removed from `text`.

    A page of which nothing remains keeps its row, with an empty text. A null text stays null. Pages
    with a null host form a host of their own, pages with a null text count as one page. The number of
    removed lines is added as `lines_dropped` (replacing a column of that name).
    """
    found = stored(boilerplate(docs, host, text, max_ratio, min_pages).select("host", "digest"), "boilerplate")
    drop, at, left = (free_name(docs, c) for c in ("_drop", "_host", "_kept"))
    per_host = found.groupBy("host").agg(F.collect_set("digest").alias(drop)).withColumnRenamed("host", at)
    if fits_broadcast(found, BROADCAST_BYTES):
        per_host = F.broadcast(per_host)
    joined = docs.join(per_host, F.col(host).eqNullSafe(F.col(at)), "left")
    lines = lines_of(F.col(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(drop, digest(x)))
    stays = F.col(drop).isNull() | F.col(text).isNull()
    return (
        joined.withColumn(left, F.when(stays, F.lit(None)).otherwise(kept))
        .withColumn(
            "lines_dropped",
            F.when(F.col(left).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left)).cast("long"),
        )
        .withColumn(text, F.when(F.col("lines_dropped") == 0, F.col(text)).otherwise(F.array_join(left, "\n")))
        .drop(left, drop, at)
    )
