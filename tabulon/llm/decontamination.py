"""Benchmark decontamination by winnowing.

Texts are words; k-grams of words get 64-bit hashes. Of every `window` consecutive words the least
k-gram hash is the fingerprint (of equal ones the last). A span of `window` words that a document
shares with a benchmark item has the same k-grams and so the same fingerprint on both sides: every
shared span is found, while neighbouring windows mostly have their fingerprint in common. Items of
fewer words are one window of their own length; each such length is a family of fingerprints.

Documents meet the benchmark twice. In the task that reads them, fingerprints are tried against a Bloom
filter of the benchmark's, of at most `FILTER_BITS` bits however large that is; it never loses one.
What passes is joined to the benchmark's fingerprints by hash, and a hit is extended to the windows it
stands for: their words, by digest, have to be those of a benchmark window. Overlapping windows are
merged into spans.

Equal texts are joined once. Fitted tables are joined by `lookup`, so a passage on a third of all
documents is neither gathered in one task nor joined against all items that share it: windows with
the same items refer to one list of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import free_name, lean, slices, stored
from tabulon.operators.lookup import lookup

WINDOW, GRAM = 10, 5
#: Bits of the filter: so many for each fingerprint of the benchmark, between these bounds.
BITS_EACH, FEWEST_BITS, FILTER_BITS = 256, 1 << 22, 1 << 28
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20

#: Which bytes belong to words (digits, letters and all of other alphabets), and A-Z in lower case.
_IS_WORD = np.zeros(256, dtype=bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _IS_WORD[_first : _last + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2^64."""
    out = np.full(BLOCK + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Where the words of several texts are, their hashes, and the text that each is in."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """`data`: the bytes of the texts one after the other; `ends`: where each text ends."""
        self.data = _LOWER[data]
        inside = _IS_WORD[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.hash = self._hashes()
        # The first word of each text, and behind the last one.
        self.bounds = np.searchsorted(self.start, np.concatenate([[0], ends]))
        self.text = np.repeat(np.arange(len(ends)), np.diff(self.bounds))

    def _hashes(self) -> np.ndarray:
        """Of each word, a polynomial of its bytes; words are cut into blocks, longer ones are hashed alone."""
        out = np.empty(len(self.start), dtype=np.uint64)
        first = 0
        while first < len(out):
            at = self.start[first]
            last = max(int(np.searchsorted(self.end, at + BLOCK, side="right")), first + 1)
            size = self.end[last - 1] - at
            if size > BLOCK:
                digest = hashlib.blake2b(self.data[at : self.end[first]].tobytes(), digest_size=8).digest()
                out[first] = int.from_bytes(digest, "little")
            else:
                terms = (self.data[at : at + size].astype(np.uint64) + np.uint64(1)) * _POWERS[:size]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
                start, end = self.start[first:last] - at, self.end[first:last] - at
                out[first:last] = mixed((sums[end] - sums[start]) * _INVERSE[start] + (end - start).astype(np.uint64))
            first = last
        return out

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k words in a row, texts aside."""
        n = max(len(self.hash) - k + 1, 0)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out = mixed(out + self.hash[j : j + n])
        return out

    def fingerprints(self, size: int) -> np.ndarray:
        """Of every `size` words in a row, the least hash of GRAM (or `size`) words in a row."""
        k = min(GRAM, size)
        grams = self.grams(k)
        n = max(len(self.hash) - size + 1, 0)
        least = grams[:n].copy()
        for j in range(1, size - k + 1):
            np.minimum(least, grams[j : j + n], out=least)
        return mixed(least ^ np.uint64(size))

    def windows(self, size: int) -> np.ndarray:
        """The first words of all windows of `size` words that lie in one text."""
        n = max(len(self.hash) - size + 1, 0)
        return np.flatnonzero(self.text[:n] == self.text[size - 1 : size - 1 + n]) if n else np.zeros(0, np.int64)

    def digest(self, first: int, size: int) -> bytes:
        """16 bytes for the words of a window."""
        data, at = self.data, range(first, first + size)
        words = b" ".join([data[self.start[i] : self.end[i]].tobytes() for i in at])
        return hashlib.md5(words, usedforsecurity=False).digest()


def words_of(texts: pa.Array) -> Words:
    """The words of an Arrow array of texts; a null text has none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
    return Words(data, (offsets[1:] - offsets[0]))


def benchmark_windows(benchmark: DataFrame, item: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item, fingerprint, key, size): every window of every item; `key` is the digest of its words.

    A null item id is written as an empty text; items without words have no windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column(1))
                rows: list[tuple] = []
                lengths = np.diff(words.bounds)
                for size in np.unique(np.minimum(lengths[lengths > 0], window)).tolist():
                    at = words.windows(size)
                    if size < window:
                        at = at[lengths[words.text[at]] == size]
                    prints = words.fingerprints(size)[at].view(np.int64)
                    owners = part.column(0).take(pa.array(words.text[at])).to_pylist()
                    rows += zip(owners, prints.tolist(), [words.digest(i, size) for i in at.tolist()], [size] * len(at))
                columns = list(zip(*rows)) or [[]] * 4
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "fingerprint", "key", "size"]
                )

    rows = benchmark.select(
        F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(lean(run), "item string, fingerprint long, key binary, size int")


class Filter:
    """A Bloom filter of fingerprints with two places each."""

    def __init__(self, prints: DataFrame):
        """Built by Spark in pieces of 4 KB; its size has the bounds above, whatever the number of rows."""
        rows = prints.select("fingerprint").distinct()
        wanted = max(FEWEST_BITS, min(FILTER_BITS, BITS_EACH * rows.count()))
        self.mask = (1 << (wanted - 1).bit_length()) - 1
        places = [F.col("fingerprint"), F.shiftrightunsigned("fingerprint", 32)]
        slot = F.explode(F.array(*[p.bitwiseAND(self.mask) + 1 for p in places]))
        pieces = (
            rows.select(slot.alias("slot"))
            .groupBy(F.bitmap_bucket_number("slot").alias("piece"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        )
        self.bits = np.zeros((self.mask + 1) // 8, dtype=np.uint8)
        for r in pieces.toLocalIterator():
            at = (r["piece"] - 1) * 4096
            self.bits[at : at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)[: len(self.bits) - at]

    def may_have(self, prints: np.ndarray) -> np.ndarray:
        out = np.ones(len(prints), dtype=bool)
        for shift in (0, 32):
            slot = (prints >> np.uint64(shift)) & np.uint64(self.mask)
            out &= (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _hits(texts: pa.Array, sizes: list[int], known: Filter) -> pa.Array:
    """Of each text the number of words, and the windows whose fingerprint passes the filter."""
    words = words_of(texts)
    starts, prints, lengths = [], [], []
    for size in sizes:
        at = words.windows(size)
        found = words.fingerprints(size)[at]
        ok = np.flatnonzero(known.may_have(found))
        starts.append(at[ok])
        prints.append(found[ok].view(np.int64))
        lengths.append(np.full(len(ok), size))
    none = [np.zeros(0, dtype=np.int64)]
    start, print_, size = (np.concatenate(x or none) for x in (starts, prints, lengths))
    text = words.text[start]
    order = np.argsort(text, kind="stable")
    start, print_, size, text = start[order], print_[order], size[order], text[order]
    keys = [words.digest(i, n) for i, n in zip(start.tolist(), size.tolist())]
    place = start - words.bounds[text]
    hits = pa.StructArray.from_arrays(
        [pa.array(print_), pa.array(keys, pa.binary()), pa.array(place, pa.int32()), pa.array(place + size, pa.int32())],
        names=["fingerprint", "key", "start", "end"],
    )
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits)
    return pa.StructArray.from_arrays([pa.array(np.diff(words.bounds)), lists], names=["words", "hits"])


def _merged(spans: str) -> str:
    """SQL for an ascending array of (start, end) with what overlaps or touches put together."""
    return f"""aggregate({spans}, cast(array() AS array<struct<start:int,end:int>>), (out, s) -> CASE
        WHEN size(out) > 0 AND element_at(out, -1).end >= s.start
        THEN concat(slice(out, 1, size(out) - 1), array(named_struct('start', element_at(out, -1).start,
            'end', greatest(element_at(out, -1).end, s.end))))
        ELSE concat(out, array(s)) END)"""


#: The columns that are added.
ADDED = ["n_words", "n_hit", "spans", "items", "contaminated"]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """`docs` without `text`, with what each document shares with the benchmark.

    Added (replacing columns of those names): `n_words`; `spans`, the stretches of words, from `start` to
    before `end`, that are covered by windows of items; `n_hit`, the number of words in them; `items`, the
    ids of the items with a window in the document, as texts in ascending order; `contaminated`, whether
    there is any. A null text has no words, and a document without words or hits has empty arrays. Each
    row keeps its place in the result, also when ids or texts repeat; items that share an id count once,
    and a null item id is the empty text. An empty benchmark contaminates nothing.
    """
    spark = docs.sparkSession
    windows = stored(benchmark_windows(benchmark, item, item_text, window), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `window` rows
    shared = spark.sparkContext.broadcast(Filter(windows))

    @F.arrow_udf("struct<words:bigint,hits:array<struct<fingerprint:bigint,key:binary,start:int,end:int>>>")
    @lean
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            parts = [
                _hits(part.column(0), sizes, known)
                for part in slices(pa.RecordBatch.from_arrays([batch], names=["text"]), "text", 2 << 20)
            ]
            yield pa.concat_arrays(parts) if parts else _hits(batch, sizes, known)

    mine, key, size = (free_name(docs, name) for name in ("_hits", "_text_key", "_size"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in ADDED]
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    measured = docs.withColumn(key, F.unhex(F.md5(value.cast("binary")))).withColumn(mine, measure(value)).select(
        *kept, key, F.col(f"{mine}.words").alias(size), F.col(f"{mine}.hits").alias(mine)
    )
    measured = stored(measured, "measured")
    found = _by_text(measured.where(F.size(mine) > 0).select(F.col(key).alias("doc"), F.col(mine).alias("hits")), windows)
    out = lookup(measured.drop(mine), found.select(F.col("doc").alias(key), F.col("found").alias(mine)), [key])
    return out.select(
        *kept,
        F.col(size).alias("n_words"),
        F.coalesce(F.expr(f"aggregate({mine}.spans, 0L, (n, s) -> n + s.end - s.start)"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(f"{mine}.spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce(f"{mine}.items", F.array().cast("array<string>")).alias("items"),
        F.col(mine).isNotNull().alias("contaminated"),
    )


def _by_text(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, found): the spans and items of every text (doc, hits) that has any."""
    each = windows.groupBy("fingerprint", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    each = stored(each.withColumn("owners", F.unhex(F.md5(F.to_json("items").cast("binary")))), "window-items")
    owners = each.groupBy("owners").agg(F.first("items").alias("items"))
    once = texts.groupBy("doc").agg(F.first("hits").alias("hits")).select("doc", F.inline("hits"))
    hits = lookup(stored(once, "hits"), each.drop("items"), ["fingerprint", "key"]).where(F.col("owners").isNotNull())
    hits = stored(hits.select("doc", "start", "end", "owners"), "matches")
    spans = hits.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    items = lookup(hits.select("doc", "owners").distinct(), owners, ["owners"])
    items = items.select("doc", F.explode("items").alias("item")).groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return spans.join(items, "doc").select("doc", F.struct(F.expr(_merged("s")).alias("spans"), "items").alias("found"))
