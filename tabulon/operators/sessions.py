"""Sessions, stage requests and run attempts as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.columns import col
from tabulon.functions.text import STAGES, canonical_stage, error_signature, merge_stages
from tabulon.operators.lookup import lookup
from tabulon.operators.ordering import positions, previous_row

# Fixed value: a run is executed at most this often.
MAX_ATTEMPTS = 4
SLOTS = ("data_path", "data_type", "task_type", "target_column", "task_intent")


def _stages() -> Column:
    return F.array(*[F.lit(s) for s in STAGES])


def run_list(requested: Column) -> Column:
    """Requested stages with everything they need, in running order.

    The dependencies form a chain, so this is every stage up to the last one requested: no join
    and no recursion.
    """
    ranks = F.transform(requested, lambda name: F.array_position(_stages(), canonical_stage(name)).cast("int"))
    return F.slice(_stages(), F.lit(1), F.coalesce(F.array_max(ranks), F.lit(0)))


def unknown_stages(requested: Column) -> Column:
    return F.array_except(F.transform(requested, canonical_stage), _stages())


def next_stage(ordered: Column, after: Column) -> Column:
    """The first stage of a run list ranked behind `after` (null: the first); END when none is."""
    start = F.coalesce(F.array_position(_stages(), after), F.lit(0))
    later = F.filter(_stages(), lambda s: (F.array_position(_stages(), s) > start) & F.array_contains(ordered, s))
    return F.coalesce(F.try_element_at(later, F.lit(1)), F.lit("END"))


def missing_slots(sessions: DataFrame) -> DataFrame:
    """Add `missing_slots` and `is_complete`: path, task type and stages must be filled in."""
    empty = [
        F.when(F.coalesce(F.length("data_path"), F.lit(0)) == 0, F.lit("data_path")),
        F.when(F.coalesce(F.length("task_type"), F.lit(0)) == 0, F.lit("task_type")),
        F.when(F.coalesce(F.size("agents_to_call"), F.lit(0)) <= 0, F.lit("agents_to_call")),
    ]
    return sessions.withColumn("missing_slots", F.array_compact(F.array(*empty))).withColumn(
        "is_complete", F.size("missing_slots") == 0
    )


def update_status(sessions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Set `status` and `last_error` of sessions that have run; `outcomes` has one row per session.

    A run that asked for no valid stage counts as failed.
    """
    runs = outcomes.select("session_id", F.col("success").alias("_ok"), F.col("error").alias("_error"))
    joined = sessions.join(runs, "session_id", "left")
    nothing = F.size(run_list(F.col("agents_to_call"))) <= 0
    ran = F.col("_ok").isNotNull()
    failed = ran & (~F.col("_ok") | nothing)
    error = F.when(nothing, "no valid stage requested").otherwise(F.col("_error"))
    return joined.withColumns(
        {
            "status": F.when(failed, "failed").when(ran, "completed").otherwise(F.col("status")),
            "last_error": F.when(failed, error).when(~ran, F.col("last_error")),
        }
    ).drop("_ok", "_error")


def latest_attempt(attempts: DataFrame, run: Sequence[str] = ("run_id",)) -> DataFrame:
    """Each run's last attempt and where it goes: save on success or at the cap, else verify."""
    last = attempts.groupBy(*run).agg(F.max_by(F.struct("attempt", "success"), "attempt").alias("a"))
    done = F.col("a.success") | (F.col("a.attempt") >= MAX_ATTEMPTS)
    return last.select(*run, "a.attempt", "a.success", F.when(done, "save").otherwise("verify").alias("route"))


def error_frequency(attempts: DataFrame, stderr: str = "stderr") -> DataFrame:
    """Fingerprints of failed attempts and how often each occurs, most frequent first."""
    failed = attempts.where(~F.col("success"))
    return failed.groupBy(error_signature(F.col(stderr)).alias("signature")).count().orderBy(F.desc("count"), "signature")


def repeated_errors(attempts: DataFrame, run: Sequence[str] = ("run_id",), stderr: str = "stderr") -> DataFrame:
    """Failed attempts with `signature` and `is_repeat`: the run's previous failure looked the same."""
    failed = attempts.where(~F.col("success")).withColumn("signature", error_signature(F.col(stderr)))
    out = previous_row(failed, list(run), ["attempt"], {"_previous": "signature"})
    return out.withColumn("is_repeat", F.coalesce(F.col("_previous") == F.col("signature"), F.lit(False))).drop("_previous")


def replay(messages: DataFrame) -> DataFrame:
    """Turns with their 1-based `position` in the conversation, however long it is."""
    return positions(messages, ["conv_id"], ["turn"])


def members(df: DataFrame, key: str, registry: DataFrame, registry_key: str) -> DataFrame:
    """Add `exists`: whether the key is in the registry."""
    known = registry.select(F.col(registry_key).alias(key)).where(col(key).isNotNull()).distinct()
    out = lookup(df, known.withColumn("_known", F.lit(True)), [key])
    return out.select(*[col(c) for c in df.columns], F.coalesce("_known", F.lit(False)).alias("exists"))


def assign_ids(registry: DataFrame, incoming: DataFrame, key: str, id_column: str = "session_id") -> DataFrame:
    """Add consecutive new ids after the registry's largest, in key order; keys are distinct."""
    top = registry.agg(F.coalesce(F.max(id_column), F.lit(0))).scalar()
    return positions(incoming, [], [key], "_n").select(
        *[col(c) for c in incoming.columns], (F.col("_n") + top).alias(id_column)
    )


def fold_slots(turns: DataFrame, key: str = "session_id", order: str = "turn", slots: Sequence[str] = SLOTS) -> DataFrame:
    """The latest stated value of every slot per session. Works on a stream as it is."""
    latest = [
        F.expr(f"max_by(`{s}`, `{order}`) FILTER (WHERE `{s}` IS NOT NULL)").alias(s) for s in slots
    ]
    return turns.groupBy(key).agg(*latest)


def merge_requests(df: DataFrame, *columns: str, name: str = "agents_to_call") -> DataFrame:
    return df.withColumn(name, merge_stages(*[F.col(c) for c in columns]))
