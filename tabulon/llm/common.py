"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.session import materialize


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet (letter case aside), made from `name`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back: cuts lineage, survives lost executors."""
    return materialize(df, f"llm-{name}")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, name: str, id_column: str = "doc_id") -> DataFrame:
    """`docs` rows with a label 0 or 1 in the column `label`; of repeated labels the larger one counts.

    A column of `docs` that is already called `label` gives way.
    """
    at = free_name(docs, "_labelled_id")
    known = (
        labels.where(F.col(name).isin(0, 1) & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias(at))
        .agg(F.max(F.col(name).cast("int")).alias("label"))
    )
    return docs.drop("label").join(known, F.col(id_column) == F.col(at)).drop(at)


def portions(texts: Iterable[str | None], characters: int = 1_000_000) -> Iterator[list[str | None]]:
    """Lists of whole texts with about so many characters each, so that what is made of them fits in memory."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= characters:
            yield part
            part, size = [], 0
    if part:
        yield part


#: Entries of a worker's memories; what they take does not grow with the corpus.
MEMO_ENTRIES = 200_000


class Memory(dict):
    """Remembers the results of a function, in two generations: the older goes when the younger is full."""

    def __init__(self, compute, most: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        """Called at the end of a task, so that a worker that is used again starts small."""
        self.clear()
        self.old = {}


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit little-endian bytes."""
    return struct.pack(f"<{len(ids)}I", *ids)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of a column each, or one row."""
    rows = max(1, batch.num_rows * most // max(batch.column(batch.schema.get_field_index(column)).nbytes, 1))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def lean(run):
    """Wraps what a Python task does with its batches: at the end, freed memory goes back to the system.

    Workers are used again by later tasks, which would otherwise start from the peak of earlier ones.
    """

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 32-bit integers."""
    x = x.astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def unit_rows(vectors, width: int | None = None):
    """Positions, width and float64 matrix of the usable vectors of a sequence.

    Null vectors, vectors with null or non-finite components, zero vectors and, when `width` is
    given, vectors of another length are left out.
    """
    keep, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or len(v) == 0 or (width is not None and len(v) != width):
            continue
        try:
            a = np.asarray(v, dtype=np.float64)
        except (TypeError, ValueError):
            continue
        if np.isfinite(a).all() and a.any():
            keep.append(i)
            rows.append(a)
    return keep, rows
