"""Best-fit packing of tokenised documents into sequences of a fixed length.

Bounded-space online best-fit: a bin is an unfinished sequence, a fixed number of bins is open, a
bitset keyed by free space finds the fullest bin that still takes a piece, and when a new bin is
needed while all are open, the fullest closes.

Pieces are dealt into buckets by a hash of document and piece; every bucket is packed on its own,
in hash order, so a repeated task gives the same result. The bins left open at the end of a bucket
are packed once more, as items, in fewer buckets: their number is the bucket count times the bound
on open bins, whatever the corpus size.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import Memory, lean, packed, slices, stored

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
PACKED_SCHEMA = f"{PIECE_SCHEMA}, bin long, place long, used long, is_open boolean"
def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(256 + rest.index(b)) if b in rest else chr(b) for b in range(256)]


# How a vocabulary file says that it lower-cases and cuts texts into the units of `WordTokenizer`.
LOWER_CASE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_words(tokenizer) -> bool:
    """Whether a loaded vocabulary cuts texts the way `WordTokenizer` does."""
    stated = json.loads(tokenizer.to_str())
    steps = (stated["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        (stated["normalizer"] or {}).get("normalizers") == LOWER_CASE
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0]["pattern"] == {"Regex": WORD_UNITS}
        and (steps[0]["behavior"], steps[0]["invert"]) == ("Removed", True)
        and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
    )


class WordTokenizer:
    """Ids of whole texts as 32-bit little-endian bytes, equal to encoding them in one call.

    The vocabulary's pre-tokeniser cuts a text at blanks and into runs of letters, digits and runs of
    symbols; the ids of a text are those of its units, so words and units are remembered. Texts with
    characters whose letter case, normal form or class may depend on more than themselves, texts
    with special tokens, and all texts if the vocabulary cuts them in another way, are encoded whole.
    """

    special = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]")
    units = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = cuts_words(self.tokenizer)
        self.letters = _byte_letters()
        self.of_unit = Memory(self._unit)
        self.of_word = Memory(lambda word: b"".join(map(self.of_unit.__getitem__, self.units.findall(word))))

    def _unit(self, unit: str) -> bytes:
        coded = "".join([self.letters[b] for b in unit.encode()])
        return packed([t.id for t in self.tokenizer.model.tokenize(coded)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words or self.special.search(text) or "<|" in text:
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.of_word.__getitem__, text.lower().split()))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once by each worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut(ids: bytes, size: int) -> Iterator[tuple[int, int, int]]:
    """Start, length and checksum of the pieces of a document of 32-bit ids."""
    for start in range(0, len(ids), 4 * size):
        part = ids[start : start + 4 * size]
        yield start // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """One row per piece of at most `size` tokens; a null text counts as empty."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        encode, end = words.encode, packed([end_id])
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [
                    (doc, k, start, length, crc)
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist())
                    for k, (start, length, crc) in enumerate(cut(encode(text) + end, size))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), PIECE_ARROW.types)], schema=PIECE_ARROW
                )
        words.of_word.forget()
        words.of_unit.forget()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


class OpenBins:
    """At most `most` open bins of `size` tokens, found by a bitset keyed by free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits, self.count, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        taken = bins.pop()
        self.count -= 1
        if not bins:
            self.bits ^= 1 << free
        return taken

    def _put(self, bin_id: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(bin_id)
        self.bits |= 1 << free
        self.count += 1

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of an item of `length` tokens."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.count == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_id, free = self.made, self.size
            self.made += 1
        if free > length:
            self._put(bin_id, free - length)
        return bin_id, self.size - free

    def place_all(self, lengths: list[int]) -> list[tuple[int, int]]:
        """Places items in the order given, but that of as many as bins can be open the longest go first."""
        out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
        for start in range(0, len(lengths), self.most):
            for i in sorted(range(start, min(start + self.most, len(lengths))), key=lambda i: -lengths[i]):
                out[i] = self.place(lengths[i])
        return out

    def open_bins(self) -> dict[int, int]:
        return {b: free for free, bins in self.by_free.items() for b in bins}


def _packer(size: int, most: int, columns: list[str]):
    """Packs one bucket; bins are numbered below a bucket's own range of 2^40."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_order", *columns], kind="stable")
        bins = OpenBins(size, most)
        placed = bins.place_all(group["length"].tolist())
        open_bins = bins.open_bins()
        ids = np.array([b for b, _ in placed], dtype=np.int64)
        out = group[columns].copy()
        out["bin"] = ids + (int(group["_bucket"].iloc[0]) << 40)
        out["place"] = [p for _, p in placed]
        out["used"] = [size - open_bins.get(b, 0) for b in ids]
        out["is_open"] = [b in open_bins for b in ids]
        return out

    return run


def pack(
    items: DataFrame,
    size: int = 2048,
    open_bins: int = 1024,
    items_per_bucket: int = 50_000,
) -> DataFrame:
    """Adds `sequence_id` and `offset` to the rows of `pieces`.

    Pieces that fill a sequence make one of their own. The others are packed in buckets of about
    `items_per_bucket`, in two rounds as the module says. Repeated rows are packed like any other.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    items = stored(items, "pieces")
    count = items.where(F.col("length") < size).count()
    buckets = -(-count // items_per_bucket) or 1
    key = F.xxhash64("doc_id", "piece", "ids_crc32")
    first = stored(
        items.where(F.col("length") < size)
        .withColumn("_order", key)
        .withColumn("_bucket", F.pmod(F.xxhash64(F.lit(1), key), F.lit(buckets)))
        .groupBy("_bucket")
        .applyInPandas(_packer(size, open_bins, columns), PACKED_SCHEMA),
        "packed",
    )
    left = (
        first.where("is_open").groupBy("bin").agg(F.first("used").alias("length")).withColumn("_order", F.xxhash64("bin"))
    )
    second = left.withColumn(
        "_bucket", F.pmod(F.xxhash64(F.lit(2), "bin"), F.lit(max(1, buckets * open_bins // items_per_bucket)))
    )
    moved = second.groupBy("_bucket").applyInPandas(
        _repacker(size, open_bins), "bin long, target long, shift long"
    )
    closed = first.where("NOT is_open").select(
        *columns, (F.col("bin") * 4).alias("sequence_id"), F.col("place").alias("offset")
    )
    reopened = first.where("is_open").join(moved, "bin").select(
        *columns, (F.col("target") * 4 + 1).alias("sequence_id"), (F.col("place") + F.col("shift")).alias("offset")
    )
    full = items.where(F.col("length") >= size).select(
        *columns, (F.monotonically_increasing_id() * 4 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return closed.unionByName(reopened).unionByName(full)


def _repacker(size: int, most: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_order", "bin"], kind="stable")
        bins = OpenBins(size, most)
        placed = bins.place_all(group["length"].tolist())
        base = int(group["_bucket"].iloc[0]) << 40
        return pd.DataFrame(
            {"bin": group["bin"], "target": [base + b for b, _ in placed], "shift": [p for _, p in placed]}
        )

    return run


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, **bounds) -> DataFrame:
    """Tokenise, cut and pack `docs` (doc_id, text, any other columns ignored).

    A null or empty text is the end id alone. An empty table gives an empty result. Rows with equal
    ids are packed one by one; a null doc_id stays null.
    """
    return pack(pieces(docs, path, size, end_id), size, **bounds)
