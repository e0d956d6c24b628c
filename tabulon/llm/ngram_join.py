"""Near duplicates by the Jaccard similarity of word n-grams, found with MinHash bands.

1. Every text becomes the set of its n-grams (64-bit hashes) and a MinHash signature; the numbers of
   bands and rows follow from the wished recall at the threshold. Texts with equal sets form a class.
2. Classes are shuffled on their band hashes. A class is tied to the smallest class of each bucket
   it shares, never to all of them, and connected components of these ties are the candidate groups.
3. Within a candidate group all pairs are verified on the full sets. A large group is cut into
   chunks by hash, and each pair of chunks is a piece of work of bounded size. It returns, for each
   class, the number of its links and the smallest class it is tied to within the piece, not pairs.
4. Components of the verified ties are the duplicate groups.

So copies and near copies cost rows in proportion to their number, while no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import free_name, lean, mix32, slices, stored
from tabulon.llm.components import components
from tabulon.operators.lookup import fits_broadcast

_WORD_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
#: A chunk of a candidate group has about so many n-grams and classes.
CHUNK_GRAMS, CHUNK_CLASSES = 200_000, 256


def choose_bands(threshold: float, recall: float = 0.999, stray: float = 0.05) -> tuple[int, int]:
    """Bands and rows: pairs at the threshold meet with probability `recall`, those at half of it with `stray` at most."""
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= stray:
            break
    return bands, rows


def grams(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams; of fewer words, all together are one n-gram."""
    from xxhash import xxh3_64_intdigest

    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.array([xxh3_64_intdigest(w) for w in words], np.uint64)
    n = min(n, len(codes))
    size = len(codes) - n + 1
    out = np.full(size, n, np.uint64)
    for j in range(n):
        out = (out ^ codes[j : j + size]) * np.uint64(_WORD_FACTORS[j % 5])
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Signer:
    """Band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.shifts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        mixed = mix32((found ^ (found >> np.uint64(32))) & np.uint64(0xFFFFFFFF))
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for start in range(0, len(mixed), 512):
            part = mixed[start : start + 512, None] * self.factors + self.shifts
            np.minimum(least, part.min(axis=0), out=least)
        grouped = least.reshape(self.bands, self.rows).astype(np.uint64)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            out = (out ^ grouped[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


def _class_of(found: np.ndarray) -> int | None:
    """A 64-bit id of a set of n-grams; an empty set has none."""
    from xxhash import xxh3_64_intdigest

    return np.uint64(xxh3_64_intdigest(found.tobytes())).astype(np.int64).item() if len(found) else None


def sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, class, n_grams, bands) of every row; a text without words has no class."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = Signer(bands, rows)

        def facts(text: str) -> tuple:
            found = grams(text, n)
            return _class_of(found), len(found), sign(found) if len(found) else None

        for batch in batches:
            for part in slices(batch, "text"):
                classes, sizes, signs = zip(*map(facts, part.column(1).to_pylist()))
                columns = [pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signs, pa.list_(pa.int64()))]
                names = ["doc_id", "text_key", "class", "n_grams", "bands"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], names=names)

    return _keyed(docs).mapInArrow(run, "doc_id long, text_key long, class long, n_grams long, bands array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(class, grams): the full sets of one text of each wanted class (doc_id, text_key)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [grams(t, n) for t in part.column(0).to_pylist()]
                columns = [
                    pa.array([_class_of(g) for g in found], pa.int64()),
                    pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["class", "grams"])

    rows = _keyed(docs)
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    wanted = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    picked = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    return picked.select("text").mapInArrow(run, "class long, grams array<long>").dropDuplicates(["class"])


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """A boolean matrix of the pairs whose Jaccard similarity is `threshold` or more."""
    sets = left + (right or [])
    count = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), count)
    shared = np.bincount(at)[at] > 1  # an n-gram of one set is in no intersection
    at, owner = at[shared], owner[shared]
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    cut = len(left)
    common = np.zeros((cut, len(right) if right is not None else cut), np.float64)
    width = 4096
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        lo, hi = np.searchsorted(at, (start, start + width))
        part = np.zeros((len(sets), min(width, int(at[-1]) + 1 - start)), np.float32)
        part[owner[lo:hi], at[lo:hi] - start] = 1
        common += part[:cut] @ (part[cut:] if right is not None else part).T
    union = count[:cut, None] + (count[cut:] if right is not None else count)[None, :] - common
    return common >= threshold * union - 1e-9


def _roots(size: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The smallest index each index is connected with."""
    label = np.arange(size)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, label[columns])
        np.minimum.at(new, columns, label[rows])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _work(key: tuple, rows: list[tuple], threshold: float) -> pd.DataFrame | None:
    """Links within a chunk (its number twice in the key) or between two chunks."""
    rows.sort(key=lambda r: r[0])
    parts = [[r for r in rows if r[1] == k] for k in dict.fromkeys(key[1:])]
    if not all(parts):
        return None
    nodes = [r for part in parts for r in part]
    cut = len(parts[0])
    if len(parts) == 1:
        linked = similar([r[3] for r in nodes], None, threshold)
        np.fill_diagonal(linked, False)
        a, b = np.nonzero(np.triu(linked))
        weights = np.array([r[2] for r in nodes], np.int64)
        links = linked @ weights
    else:
        linked = similar([r[3] for r in parts[0]], [r[3] for r in parts[1]], threshold)
        a, b = np.nonzero(linked)
        b = b + cut
        first, second = (np.array([r[2] for r in part], np.int64) for part in parts)
        links = np.concatenate((linked @ second, linked.T @ first))
    if not len(a):
        return None
    ids = np.array([r[0] for r in nodes], np.int64)
    root = ids[_roots(len(ids), a, b)]
    some = links > 0
    return pd.DataFrame({"class": ids[some], "root": root[some], "links": links[some]})


def verify(sets: DataFrame, threshold: float) -> DataFrame:
    """(class, root, links) from (comp, low, high, class, chunk, size, grams), a piece of work per (comp, low, high)."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for batch in batches:
            named = zip(
                zip(batch["comp"].tolist(), batch["low"].tolist(), batch["high"].tolist()),
                zip(batch["class"].tolist(), batch["chunk"].tolist(), batch["size"].tolist(), batch["grams"]),
            )
            done = []
            for k, row in named:
                if k != key:
                    if rows:
                        done.append(_work(key, rows, threshold))
                    key, rows = k, []
                rows.append(row)
            done = [d for d in done if d is not None]
            if done:
                yield pd.concat(done)
        if rows and (last := _work(key, rows, threshold)) is not None:
            yield last

    key = ["comp", "low", "high"]
    return sets.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "class long, root long, links long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text_key, n_links, component_id, kept.

    `n_links` is the number of other rows with similarity `threshold` or more; `component_id` the
    smallest doc_id that links lead to. `kept` holds for one text of each group, the one with the
    smallest doc_id (equal ids: the smallest text_key). Repeated rows link with one another and are
    kept or dropped together. A null or blank text has no n-grams and links with nothing: its
    component is its own id and it is kept. A null id comes after all others.
    """
    bands, rows = choose_bands(threshold, recall)
    each = stored(sketch(docs, n, bands, rows), "sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")).alias("first")
    classes = stored(
        each.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.count("*").alias("size"), first, F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")),
        "classes",
    )
    banded = classes.select("class", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("class").alias("least"), F.count("*").alias("n")).where("n > 1")
    ties = banded.join(buckets, "band").where("class <> least").select("class", "least")
    groups = components(ties, "class", "least")
    sizes = groups.join(classes.select(F.col("class").alias("id"), "size", "n_grams", "first"), "id")
    chunks = F.greatest(F.ceil(F.sum("n_grams") / CHUNK_GRAMS), F.ceil(F.count("*") / CHUNK_CLASSES))
    candidates = stored(
        sizes.join(sizes.groupBy("component").agg(chunks.alias("chunks")), "component").select(
            F.col("id").alias("class"), F.col("component").alias("comp"), "size", "chunks",
            F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), "first.doc_id", "first.text_key",
        ),
        "candidates",
    )
    sets = candidates.join(_full_sets(docs, candidates, n), "class")
    work = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(
        "comp", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"),
        "class", "chunk", "size", "grams",
    )
    linked = stored(verify(work, threshold), "links")
    joined = components(linked, "class", "root").withColumnRenamed("id", "class")
    links = linked.groupBy("class").agg(F.sum("links").alias("links"))
    summary = (
        classes.select("class", "size", "first")
        .join(links, "class", "left")
        .join(joined, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    summary = stored(summary, "summary")
    leaders = summary.groupBy("component").agg(F.min("first").alias("leader"))
    facts = summary.join(leaders, "component").select(
        "class", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "leader"
    )
    same = F.col("doc_id").eqNullSafe(F.col("leader.doc_id")) & (F.col("text_key") == F.col("leader.text_key"))
    return each.join(facts, "class", "left").select(
        "doc_id",
        "text_key",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("leader").isNull(), F.col("doc_id")).otherwise(F.col("leader.doc_id")).alias("component_id"),
        F.when(F.col("leader").isNull(), True).otherwise(same).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999) -> DataFrame:
    """`docs`, all columns, with one row of each group of near duplicates; see `near_duplicates`.

    Of repeated rows (equal id and text) of a group, one stays.
    """
    found = stored(near_duplicates(docs, threshold, n, recall), "near-duplicates")
    near_id, near_key, near_text = (free_name(docs, c) for c in ("_near_id", "_near_key", "_near_text"))
    gone = found.where("NOT kept").select(F.col("doc_id").alias(near_id), F.col("text_key").alias(near_key)).distinct()
    gone = stored(gone, "gone")
    gone = F.broadcast(gone) if fits_broadcast(gone) else gone
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(near_id)) & (F.col(near_text) == F.col(near_key))
    left = docs.withColumn(near_text, key).join(gone, same, "left_anti")
    repeated = (
        found.where("kept AND n_links > 0").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
        .select(F.col("doc_id").alias(near_id), F.col("text_key").alias(near_key))
    )
    if not repeated.isEmpty():
        once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", near_text])
        left = left.join(repeated, same, "left_anti").unionByName(once)
    return left.drop(near_text)
