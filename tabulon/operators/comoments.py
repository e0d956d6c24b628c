"""Co-moments of many columns in one scan, and the correlations that follow from them.

The state of a tile (a block of columns against another) holds, for every pair of its columns, the
number of rows that have both, both means, and the sums of squares and products about them. States of
different rows merge into the state of all of them, so every batch, task and later delivery of data is
reduced on its own, and what is shuffled does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.functions.columns import number, numeric_columns
from tabulon.operators.lookup import lookup
from tabulon.operators.ordering import running_totals
from tabulon.session import materialize, ship_package

#: Columns of a block; a state takes 48 bytes for each pair of a tile.
BLOCK = 64
#: States that are merged by one task of the first round.
FAN_IN = 64
STATE = "tile int, state binary"


def tiles(width: int) -> list[tuple[slice, slice]]:
    """Pairs of column blocks that cover every pair of columns."""
    blocks = [slice(i, min(i + BLOCK, width)) for i in range(0, width, BLOCK)]
    return [(a, b) for i, a in enumerate(blocks) for b in blocks[i:]]


def tile_state(x: np.ndarray, a: slice, b: slice) -> np.ndarray:
    """The state (6, columns of a, columns of b) of some rows; a missing value is NaN."""
    there = ~np.isnan(x)
    # Sums about a value of the column: exact zeros for a constant column, no cancellation otherwise.
    shift = np.where(there.any(axis=0), x[there.argmax(axis=0), np.arange(x.shape[1])], 0.0) if len(x) else np.zeros(x.shape[1])
    z = np.where(there, x - shift, 0.0)
    m = there.astype(np.float64)
    n = m[:, a].T @ m[:, b]
    sums = z[:, a].T @ m[:, b], m[:, a].T @ z[:, b]
    some = np.maximum(n, 1)
    mean_a, mean_b = sums[0] / some, sums[1] / some
    return np.stack([
        n, np.where(n > 0, mean_a + shift[a, None], 0.0), np.where(n > 0, mean_b + shift[None, b], 0.0),
        np.maximum((z[:, a] ** 2).T @ m[:, b] - sums[0] * mean_a, 0.0),
        np.maximum(m[:, a].T @ (z[:, b] ** 2) - sums[1] * mean_b, 0.0),
        z[:, a].T @ z[:, b] - sums[0] * mean_b,
    ])


def merged(one: np.ndarray | None, two: np.ndarray) -> np.ndarray:
    """The state of the rows of both."""
    if one is None:
        return two
    n = one[0] + two[0]
    share = np.where(n > 0, two[0] / np.maximum(n, 1), 0.0)
    da, db = two[1] - one[1], two[2] - one[2]
    both = one[0] * share
    return np.stack([
        n, np.where(one[0] > 0, one[1] + da * share, two[1]), np.where(one[0] > 0, one[2] + db * share, two[2]),
        one[3] + two[3] + da * da * both, one[4] + two[4] + db * db * both, one[5] + two[5] + da * db * both,
    ])


def _rows(found: dict[int, np.ndarray]) -> pa.RecordBatch:
    states = pa.array([s.tobytes() for s in found.values()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), states], names=["tile", "state"])


def comoments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(tile, state): one row per tile; NaN counts as missing. States of equal columns can be merged."""
    columns = list(columns or numeric_columns(df))
    return _comoments(df.select(F.array(*[number(df, c) for c in columns]).alias("x")), len(columns))


def _comoments(rows: DataFrame, width: int) -> DataFrame:
    ship_package(rows.sparkSession)
    cover = tiles(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(-1, width)
            for i, (a, b) in enumerate(cover):
                found[i] = merged(found.get(i), tile_state(x, a, b))
        if found:
            yield _rows(found)

    return merge_comoments(rows.mapInArrow(run, STATE), width)


def merge_comoments(states: DataFrame, width: int) -> DataFrame:
    """One state per tile from any number of them, in two rounds, so that no task gets all."""
    cover = tiles(width)

    def run(table: pa.Table) -> pa.Table:
        found: dict[int, np.ndarray] = {}
        for tile, state in zip(table.column("tile").to_pylist(), table.column("state").to_pylist()):
            a, b = cover[tile]
            state = np.frombuffer(state).reshape(6, a.stop - a.start, b.stop - b.start)
            found[tile] = merged(found.get(tile), state)
        return pa.Table.from_batches([_rows(found)])

    few = states.withColumn("part", F.floor(F.spark_partition_id() / FAN_IN)).groupBy("tile", "part").applyInArrow(run, STATE)
    return few.groupBy("tile").applyInArrow(run, STATE)


def correlation_pairs(states: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n, r) of every pair of columns; `r` is null where a column has one value or no row has both."""
    columns, cover = list(columns), tiles(len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = cover[tile]
                state = np.frombuffer(state).reshape(6, a.stop - a.start, b.stop - b.start)
                left, right = np.meshgrid(np.arange(a.start, a.stop), np.arange(b.start, b.stop), indexing="ij")
                keep = left < right
                n, _, _, va, vb, both = (s[keep] for s in state)
                scale = np.sqrt(va) * np.sqrt(vb)
                ok = scale > 0
                r = np.divide(both, scale, where=ok, out=np.zeros_like(scale))
                yield pa.RecordBatch.from_arrays([
                    pa.array([columns[i] for i in left[keep]], pa.string()), pa.array([columns[i] for i in right[keep]], pa.string()),
                    pa.array(n.astype(np.int64)), pa.array(r, mask=~ok | np.isnan(r)),
                ], names=["a", "b", "n", "r"])

    return states.mapInArrow(run, "a string, b string, n long, r double")


def spreads(states: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, variance) of every column, the variance that of a sample; `n` counts its present values."""
    columns, cover = list(columns), tiles(len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = cover[tile]
                if a != b:
                    continue
                n, mean, _, squares, _, _ = (np.diagonal(s) for s in np.frombuffer(state).reshape(6, a.stop - a.start, -1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[a], pa.string()), pa.array(n.astype(np.int64)), pa.array(mean.copy(), mask=n < 1),
                    pa.array(squares / np.maximum(n - 1, 1), mask=n < 1),
                ], names=["column", "n", "mean", "variance"])

    return states.mapInArrow(run, "column string, n long, mean double, variance double")


def mid_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`x`, the array of each row's ranks within the columns, over rows without missing values.

    Equal values share the mean of their ranks. Values are counted per column before anything is ordered,
    counts are ranked in range slices, and the ranks come back by a join that splits hot values, so a value
    on half of all rows is nowhere in one task.
    """
    complete = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(columns)]).na.drop()
    rows = complete.select(F.array("*").alias("x")).withColumn("row", F.monotonically_increasing_id())
    cells = materialize(rows.select("row", F.posexplode("x").alias("at", "value")), "cells")
    counts = cells.groupBy("at", "value").agg(F.count("*").alias("n"))
    totals = running_totals(counts, ["at"], ["value"], {"upto": "n"})
    ranks = totals.select("at", "value", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    ranked = lookup(cells, ranks, ["at", "value"])
    ordered = F.array_sort(F.collect_list(F.struct("at", "rank")))
    return ranked.groupBy("row").agg(ordered.alias("x")).select(F.transform("x", lambda s: s["rank"]).alias("x"))


def rank_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman's correlation of every pair, as `correlation_pairs`."""
    return correlation_pairs(_comoments(mid_ranks(df, columns), len(columns)), columns)
