"""Nearest neighbours by counting collisions of single projections.

Every vector is projected on `projections` random directions and each projection is kept as a sorted
array. A query opens a window around its own place in every array; a vector collides once for each
window it lies in, and when its collisions reach `share` of the projections its exact score is
computed. All windows widen together (virtual rehashing) until they are as wide as needed for a vector
at the distance of the present k-th best to reach the threshold with probability `recall`. So the
search ends by what it has found, not after a number of candidates.

Collisions are counted for 64 vectors at a time. Every sorted array has marks, and for each mark the set of the vectors
before it as bits. A window, widened to the next marks, is the difference of two such sets, and the sets of all
projections are added bit by bit (carry-save), so a window costs the words of a set however many places it covers.

The largest inner product is the smallest distance once each vector gets one more component that
brings it to the largest norm, and queries a zero.

Rows are dealt into blocks of bounded size by a hash of the id. A block is indexed once, by one task, and
every query passes through it in batches: a query leaves with the best k of the block, and the best k of
all blocks are its result. So rows are moved once, and queries once for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tabulon.llm.common import stored

#: How much windows widen at a time, and where they start as a share of the width at the largest norm.
WIDEN, FIRST = 1.5, 0.5
#: Bits that the marks of one projection take, about, and marks it has at least if there are as many rows.
MARK_BITS, LEAST_MARKS = 1 << 22, 128
#: Words of the sets that are added together; queries are searched together up to that, so that it stays in a cache.
TOGETHER = 1 << 19


@cache
def needed_width(projections: int, share: float, recall: float) -> float:
    """Half width, in units of a vector's distance, at which it reaches the threshold with probability `recall`."""
    least = math.ceil(share * projections)

    def reached(width: float) -> float:
        p = math.erf(width / math.sqrt(2))
        return sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(least, projections + 1))

    low, high = 0.0, 20.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if reached(middle) >= recall else (middle, high)
    return high


def bit_sums(sets: np.ndarray) -> list[np.ndarray]:
    """Of how many `sets` (bits, along the first axis) each element is a member: the bits of the numbers, lowest first."""
    out = []
    while len(sets):
        carries = []
        while len(sets) > 1:
            third = len(sets) // 3
            if third:
                one, two, three = sets[:third], sets[third : 2 * third], sets[2 * third : 3 * third]
                odd = one ^ two
                carries.append(one & two | odd & three)
                sets = np.concatenate((odd ^ three, sets[3 * third :]))
            else:
                carries.append(sets[:1] & sets[1:])
                sets = sets[:1] ^ sets[1:]
        out.append(sets[0])
        sets = np.concatenate(carries) if carries else sets[:0]
    return out


def at_least(sums: list[np.ndarray], least: int) -> np.ndarray:
    """The elements whose number, in bits as from `bit_sums`, is `least` or more."""
    more, same = np.zeros_like(sums[0]), ~np.zeros_like(sums[0])
    for i in reversed(range(len(sums))):
        if least >> i & 1:
            same = same & sums[i]
        else:
            more, same = more | same & sums[i], same & ~sums[i]
    return more | same


class CollisionIndex:
    """Sorted projections of the rows of a block: their marks, and the rows before each mark as bits."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, projections: int, seed: int = 5):
        self.ids, self.vectors, self.longest, self.verified = ids, vectors, longest, 0
        # Scaled by the longest vector, so that single precision neither overflows nor vanishes.
        self.rough = (vectors / (longest or 1.0)).astype(np.float32)
        rest = np.sqrt(np.maximum(longest**2 - np.square(vectors).sum(axis=1), 0))
        self.directions = np.random.default_rng(seed).standard_normal((projections, vectors.shape[1] + 1))
        count = len(ids)
        step = max(1, math.ceil(count / max(LEAST_MARKS, MARK_BITS // count)))
        group, last = np.arange(count) // step, np.minimum(np.arange(step - 1, count + step - 1, step), count - 1)
        self.words = math.ceil(count / 64)
        self.before = np.zeros((projections, len(last) + 1, self.words), "<u8")
        self.lowest, self.highest = np.empty((2, projections, len(last)))
        placed = self.directions[:, :-1] @ vectors.T + self.directions[:, -1:] * rest
        for i, values in enumerate(placed):
            order = np.argsort(values)
            self.lowest[i], self.highest[i] = values[order[::step]], values[order[last]]
            np.bitwise_or.at(self.before[i], (group + 1, order >> 6), np.uint64(1) << (order & 63).astype(np.uint64))
            np.bitwise_or.accumulate(self.before[i], axis=0, out=self.before[i])

    def bits(self, members: np.ndarray) -> np.ndarray:
        """A set of rows as words."""
        out = np.zeros(8 * self.words, np.uint8)
        packed = np.packbits(members, bitorder="little")
        out[: len(packed)] = packed
        return out.view("<u8")

    def reached(self, places: np.ndarray, widths: np.ndarray, least: int) -> np.ndarray:
        """For each query (a column of `places`) the rows in at least `least` of its windows, as words."""
        low = np.stack([np.searchsorted(ends, v) for ends, v in zip(self.highest, places - widths)])
        high = np.stack([np.searchsorted(starts, v) for starts, v in zip(self.lowest, places + widths)])
        # Nothing is outside an infinite window.
        low[:, np.isinf(widths)], high[:, np.isinf(widths)] = 0, self.before.shape[1] - 1
        each = np.arange(len(places))[:, None]
        return at_least(bit_sums(self.before[each, high] ^ self.before[each, low]), least)

    def search(self, query_id: int, query: np.ndarray, k: int, share: float, recall: float) -> list[tuple[int, float]]:
        """The best k found: (id, inner product), the largest first, ties to the smaller id."""
        return self.search_all([query_id], query[None], k, share, recall)[0]

    def search_all(
        self, query_ids: list[int], queries: np.ndarray, k: int, share: float, recall: float
    ) -> list[list[tuple[int, float]]]:
        """`search` of every query; as many as suit a cache widen their windows together."""
        most = max(1, TOGETHER // (len(self.directions) * self.words))
        parts = [slice(i, i + most) for i in range(0, len(query_ids), most)]
        return [found for p in parts for found in self._search(query_ids[p], queries[p], k, share, recall)]

    def _search(self, query_ids, queries, k, share, recall):
        count = len(self.directions)
        least = math.ceil(share * count)
        ratio = needed_width(count, share, recall)
        places = self.directions[:, :-1] @ queries.T
        norms = [float(np.linalg.norm(q)) for q in queries]
        rough_queries = [(q / (n or 1.0)).astype(np.float32) for q, n in zip(queries, norms)]
        margin = 4e-7 * (queries.shape[1] + 4)  # more than the rounding of two single-precision products of unit vectors
        sizes = [math.sqrt(self.longest**2 + float(q @ q)) for q in queries]
        widths = FIRST * ratio * np.array(sizes)
        waiting = np.stack([self.bits(self.ids != i) for i in query_ids])
        found = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        active = list(range(len(queries)))
        while active:
            reached = self.reached(places[:, active], widths[active], least) & waiting[active]
            waiting[active] ^= reached
            going = []
            for at, bits in zip(active, reached):
                found_ids, found_scores = found[at]
                new = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))
                if len(new):
                    self.verified += len(new)
                    # Single precision rules out what cannot be among the best; the rest is computed in double.
                    rough = self.rough[new] @ rough_queries[at]
                    if len(new) > k:
                        new = new[rough >= np.partition(rough, -k)[-k] - margin]
                    found_ids = np.concatenate((found_ids, self.ids[new]))
                    found_scores = np.concatenate((found_scores, [float(v @ queries[at]) for v in self.vectors[new]]))
                    best = np.lexsort((found_ids, -found_scores))[:k]
                    found[at] = found_ids, found_scores = found_ids[best], found_scores[best]
                if not waiting[at].any():
                    continue
                wide, width = math.inf, float(widths[at])
                if len(found_ids) == k:
                    wide = ratio * math.sqrt(max(sizes[at] ** 2 - 2 * float(found_scores[-1]), 0.0))
                    if width >= wide:
                        continue
                widths[at] = min(width * WIDEN, max(wide, width * 1.01))
                going.append(at)
            active = going
        return [list(zip(ids.tolist(), scores.tolist())) for ids, scores in found]


def block_count(rows: int, rows_per_block: int, fewest: int = 8192, tasks: int = 4) -> int:
    """Blocks of at most about `rows_per_block` rows; a small table has up to `tasks` blocks of `fewest` rows or more."""
    return max(1, math.ceil(rows / min(rows_per_block, max(fewest, rows / tasks))))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    projections: int = 160,
    share: float = 0.85,
    recall: float = 0.97,
    rows_per_block: int = 65_536,
    id_column: str = "vec_id",
    column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` largest inner products found for every query.

    `vectors` and `queries` have an id and a vector. Rows with the query's id are not its neighbours;
    repeated rows are neighbours of their own. Null and zero vectors, vectors with null or non-finite
    components, vectors that have not the commonest length and rows with a null id take no part. A
    query has fewer than k results only where there are fewer candidates. A task holds one block:
    for each projection 16 bytes a row or, in a small block, up to half a MB, and 12 bytes for each component of its rows.
    """
    result = f"query_id long, {id_column} long, score double"
    pick = [F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")]
    rows = vectors.select(*pick).where("id IS NOT NULL AND size(v) > 0")
    asked = queries.select(*pick).where("id IS NOT NULL AND size(v) > 0")
    counted = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "width").first()
    width, count = (top["width"], top["n"]) if top else (0, 0)
    usable = (
        (F.size("v") == width)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
        & F.exists("v", lambda x: x != 0)
    )
    rows, asked = stored(rows.where(usable), "rows"), stored(asked.where(usable), "queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    longest = rows.agg(F.max(norm)).first()[0] or 0.0
    blocks = block_count(count, rows_per_block)

    held = rows.select(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    posed = asked.select(every.alias("block"), F.lit(1).alias("asks"), "id", "v")
    dealt = held.unionByName(posed).repartitionById(blocks, "block").sortWithinPartitions("block", "asks", "id")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition's rows come before its queries."""
        ids, parts, index = [], [], None
        for batch in batches:
            asks = (batch["asks"] == 1).to_numpy()
            if not asks.all():
                ids.append(batch["id"].to_numpy()[~asks])
                parts.append(np.stack(batch["v"][~asks]))
            if asks.any() and ids:
                if index is None:
                    index = CollisionIndex(np.concatenate(ids), np.concatenate(parts), longest, projections)
                    parts.clear()
                query_ids = batch["id"][asks].tolist()
                answers = index.search_all(query_ids, np.stack(batch["v"][asks]), k, share, recall)
                out = [(query_id, i, s) for query_id, found in zip(query_ids, answers) for i, s in found]
                yield pd.DataFrame(out, columns=["query_id", id_column, "score"])

    found = dealt.mapInPandas(answer, result)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", id_column, "score")
    )
