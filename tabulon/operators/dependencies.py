"""Stages and what they require, as a table: everything a request needs, in running order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulon.operators.lookup import lookup
from tabulon.operators.ordering import positions
from tabulon.session import materialize


def closure(prerequisites: DataFrame) -> DataFrame:
    """(stage, requires): what every stage requires directly or through others.

    The length of the chains that are known doubles with each round, and the rounds end when nothing is
    added, so cycles and branches that meet again do no harm. Only pairs of stages are ever built.
    """
    known = prerequisites.select("stage", "requires").where("stage IS NOT NULL AND requires IS NOT NULL").distinct()
    known, size = materialize(known, "closure"), -1
    while (now := known.count()) > size:
        size = now
        on = known.select(F.col("stage").alias("requires"), F.col("requires").alias("far"))
        longer = known.join(on, "requires").select("stage", F.col("far").alias("requires"))
        known = materialize(known.unionByName(longer).distinct(), "closure")
    return known


def run_order(requests: DataFrame, prerequisites: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, stage, position, reason): what every session has to run, and what it cannot.

    `requests` has a row per session and requested `stage`, `prerequisites` (stage, requires) a row per
    requirement; a stage that requires nothing has one with a null. The stages of a session are its
    requests and all they require, from `position` 1, each behind what it requires; stages that do not
    require each other are ordered by how much they require, then by name. A request that is in
    neither column of `prerequisites`, or that requires a stage that requires itself, is not run and nothing
    is run for it: it is a row without position whose `reason` says so, naming the first such stage.
    Repeated rows count once, null stages are ignored, and a session without requests has no rows.
    """
    every = closure(prerequisites)
    names = prerequisites.select("stage").unionByName(prerequisites.select(F.col("requires").alias("stage")))
    circular = every.where("stage = requires").select("stage")
    # A stage that requires another requires all that one does and the other itself: the number tells the order.
    sizes = every.groupBy("stage").agg(F.count("*").alias("size"))
    stuck = every.join(circular.withColumnRenamed("stage", "requires"), "requires").groupBy("stage").agg(F.min("requires").alias("knot"))
    known = names.where("stage IS NOT NULL").distinct().join(sizes, "stage", "left").join(stuck, "stage", "left")
    known = materialize(known.select("stage", F.coalesce("size", F.lit(0)).alias("size"), "knot", F.lit(True).alias("known")), "stages")

    asked = requests.select(F.col(session).alias("session"), "stage").where("stage IS NOT NULL").distinct()
    asked = materialize(lookup(asked, known, ["stage"], stored=True), "asked")
    runs = asked.where("known AND knot IS NULL").select("session", "stage")
    needs = every.groupBy("stage").agg(F.collect_list("requires").alias("all"))
    needed = lookup(runs, needs, ["stage"]).select("session", F.explode(F.concat(F.array("stage"), F.coalesce("all", F.array().cast("array<string>")))).alias("stage"))
    ordered = lookup(needed.distinct(), known.select("stage", "size"), ["stage"])
    placed = positions(ordered, ["session"], ["size", "stage"]).select("session", "stage", "position", F.lit(None).cast("string").alias("reason"))
    refused = asked.where("known IS NULL OR knot IS NOT NULL").select(
        "session", "stage", F.lit(None).cast("long").alias("position"),
        F.when(F.col("known").isNull(), "unknown stage").otherwise(F.concat(F.lit("requires itself: "), F.col("knot"))).alias("reason"),
    )
    return placed.unionByName(refused).withColumnRenamed("session", session)
