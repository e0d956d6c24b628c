"""The slot fold as a stream: sessions are updated as turns arrive, and forgotten when none do.

The state of a session is one row, the latest value and turn of every slot, in RocksDB. It lives for
`idle` after the session's last turn, so the state is bounded by the sessions of that time and not by
all there ever were. What is written carries the turn of every value, so a session that comes back
after its state is gone is merged with what was written before, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tabulon.functions.columns import col
from tabulon.operators.sessions import SLOTS
from tabulon.session import materialize, ship_package
from tabulon.sources.store import read_store, update_store

IDLE = 7 * 24 * 3600.0
#: What the stream needs of the session: state in RocksDB, and batches only when there are turns. State that
#: lives for a time would otherwise make empty batches without end.
NEEDED = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def turn_of(slot: str) -> str:
    """The column that tells which turn a slot's value is from."""
    return f"{slot}__turn"


class SlotFold(StatefulProcessor):
    """Folds the turns of a session into its state and gives the state back."""

    def __init__(self, key: str, slots: Sequence[str], idle: float):
        self.slots, self.idle = list(slots), idle
        self.version = Row(key, *[name for s in slots for name in (s, turn_of(s))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"v{i} string, t{i} long" for i in range(len(self.slots)))
        self.latest = handle.getValueState("latest", fields, int(self.idle * 1000))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = list(self.latest.get()) if self.latest.exists() else [None] * (2 * len(self.slots))
        for row in rows:
            if row["turn"] is None:
                continue
            for i, slot in enumerate(self.slots):
                value, seen = row[slot], state[2 * i + 1]
                # Of equal turns the larger value, so that the order of arrival does not matter.
                if value is not None and (seen is None or (row["turn"], value) > (seen, state[2 * i])):
                    state[2 * i : 2 * i + 2] = [value, row["turn"]]
        self.latest.update(tuple(state))
        yield self.version(*key, *state)

    def close(self) -> None:
        pass


def merge_folds(key: str, slots: Sequence[str]):
    """Merges written versions of sessions: of every slot the value with the latest turn."""

    def merge(rows: DataFrame) -> DataFrame:
        latest = []
        for s in slots:
            order = F.when(col(s).isNotNull(), F.struct(col(turn_of(s)), col(s)))
            latest += [F.max_by(col(s), order).alias(s), F.max(F.when(col(s).isNotNull(), col(turn_of(s)))).alias(turn_of(s))]
        return rows.groupBy(col(key)).agg(*latest)

    return merge


def start_fold(
    turns: DataFrame,
    out: str,
    checkpoint: str,
    key: str = "session_id",
    slots: Sequence[str] = SLOTS,
    once: bool = True,
    idle: float = IDLE,
):
    """Fold a stream of turns (`key`, `turn` and the text `slots`) into the session store at `out`.

    The order of arrival does not matter, because `turn` decides which value is latest. Every batch
    rewrites the buckets of the sessions it changed; a batch that is replayed writes the same again.
    `idle` seconds after its last turn a session leaves the state, with the next batch, and stays in the
    store. The session's own settings are put back once the stream has started.
    """
    spark = turns.sparkSession
    ship_package(spark)
    fields = [T.StructField(key, turns.schema[key].dataType)]
    for s in slots:
        fields += [T.StructField(s, T.StringType()), T.StructField(turn_of(s), T.LongType())]
    rows = turns.select(col(key), F.col("turn").cast("long").alias("turn"), *[col(s).cast("string").alias(s) for s in slots])
    folded = rows.groupBy(key).transformWithState(SlotFold(key, slots, idle), T.StructType(fields), "Update", "ProcessingTime")
    merge = merge_folds(key, slots)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Written once before it is used, as every use of a batch would run the state again.
        update_store(materialize(batch, "fold"), out, [key], merge, batch_id)

    writer = folded.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    before = {name: spark.conf.get(name, None) for name in NEEDED}
    try:
        for name, value in NEEDED.items():
            spark.conf.set(name, value)
        return writer.trigger(availableNow=True).start() if once else writer.start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def folded_sessions(
    spark, out: str, key: str = "session_id", slots: Sequence[str] = SLOTS, key_type: T.DataType | None = None
) -> DataFrame:
    """Every session in the store, once, with the latest value of each slot.

    With the `key_type`, a store that no turn has reached yet is an empty table, and not an error.
    """
    schema = None
    if key_type is not None:
        schema = T.StructType([T.StructField(key, key_type), *[T.StructField(s, T.StringType()) for s in slots]])
    return read_store(spark, out, schema).select(col(key), *[col(s) for s in slots])
