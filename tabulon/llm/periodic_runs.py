"""Periodic runs of words in a text, by seeds that are extended along diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no
neighbouring word extends, of `min_length` words and `exponent` periods at least. On the diagonal of
lag q it is a stretch of equal words of at least max(min_length - q, (exponent - 1) * q).

Seeds: lags are taken in bands (2^j, 2^(j+1)]. For a band, k is the smallest such overlap any of its
lags guarantees, and the k-grams of the text are indexed. Only neighbouring occurrences of a k-gram
are paired, so a word that is repeated all through a text gives as many pairs as it has occurrences.
That loses no run: k is at least q in its band, so if the k-gram at the start of a run came back after
d < q words, the run would have both periods over k + d >= q + d words and hence (Fine and Wilf) a
period that divides q. The next occurrence is therefore the one q words on. For the same reason a pair
never has a lag with a shorter period inside, and each text has fewer runs than words to extend.

Extension: from a seed the diagonal is followed both ways to the first difference. A table of how far
each lag is covered skips the other seeds of a stretch.

Names of k-grams are exact (numbers given to equal pairs of shorter names, no hashes), and only
positions whose shorter name occurs twice are named at the next band. A text is one row and is handled
by one task, in time n log n.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import free_name, lean

MIN_LENGTH, EXPONENT = 6, 4


def bands(n: int, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(k, lowest lag, highest lag) of every band that fits into n words; k never falls."""
    if exponent < 3:
        raise ValueError("the seeds are only complete from three periods on")
    out, low = [], 0
    while (low + 1) * exponent <= n and max(min_length, (low + 1) * exponent) <= n:
        high = max(2 * low, low + 1)
        lags = range(low + 1, min(high, low + min_length) + 1)
        out.append((min(max(min_length - q, (exponent - 1) * q) for q in lags), low + 1, high))
        low = high
    for i in range(len(out) - 2, -1, -1):
        out[i] = (min(out[i][0], out[i + 1][0]), *out[i][1:])
    return out


class Names:
    """Exact names of the k-grams that occur at least twice: `at` (ascending) and `name`."""

    def __init__(self, words: np.ndarray):
        self.n, self.k = len(words), 1
        self.at, self.name = np.arange(len(words)), words
        self._repeated(words)

    def _repeated(self, keys: np.ndarray) -> None:
        _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
        keep = times[name] > 1
        self.at, self.name = self.at[keep], name[keep]

    def grow(self, k: int) -> None:
        """From the names of shorter grams to those of k-grams."""
        while self.k < k and len(self.at):
            step = min(self.k, k - self.k)
            all_names = np.full(self.n + step, -1, dtype=np.int64)
            all_names[self.at] = self.name
            behind = all_names[self.at + step]
            ok = behind >= 0
            first, behind = self.name[ok], behind[ok]
            self.at = self.at[ok]
            self._repeated(first * (behind.max(initial=0) + 1) + behind)
            self.k += step

    def pairs(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(lag, place) of neighbouring occurrences of a gram whose lag is in the band, in that order."""
        order = np.argsort(self.name, kind="stable")
        at, name = self.at[order], self.name[order]
        lag = np.where(name[1:] == name[:-1], at[1:] - at[:-1], 0)
        found = np.flatnonzero((lag >= low) & (lag <= high))
        lag, at = lag[found], at[found]
        order = np.lexsort((at, lag))
        return lag[order], at[order]


def stretch(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The places t around `at`, from the first to behind the last, with words[t] == words[t + lag]."""
    most, end, size = len(words) - lag, at, 64
    while end < most:
        stop = min(end + size, most)
        differs = words[end:stop] != words[end + lag : stop + lag]
        if differs.any():
            end += int(differs.argmax())
            break
        end, size = stop, 2 * size
    start, size = at, 64
    while start > 0:
        stop = max(start - size, 0)
        differs = (words[stop:start] != words[stop + lag : start + lag])[::-1]
        if differs.any():
            start -= int(differs.argmax())
            break
        start, size = stop, 2 * size
    return start, end


def runs_of(
    words: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT
) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text given as word numbers, by start and period."""
    names, found = Names(words), []
    for k, low, high in bands(len(words), min_length, exponent):
        names.grow(k)
        if not len(names.at):
            break
        lags, places = names.pairs(low, high)
        ends = np.flatnonzero(np.diff(lags, append=-1)) + 1
        begin = 0
        for end in ends:
            lag, covered, i = int(lags[begin]), 0, begin
            while i < end:
                start, covered = stretch(words, int(places[i]), lag)
                length = covered + lag - start
                if length >= max(min_length, exponent * lag):
                    found.append((start, length, lag))
                i = begin + int(np.searchsorted(places[begin:end], covered))
            begin = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    number = defaultdict(count().__next__)
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, without those of a run behind its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def with_runs(
    docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT
) -> DataFrame:
    """Adds `runs`, an array of (start, length, period) by start and period, and `collapsed`.

    Words are what stands between blanks, tabs and line ends; places and lengths count words from 0.
    `collapsed` is the text's words joined by one space, each run cut to its first period. A null or
    empty text has no runs and an empty `collapsed`. Rows are independent of each other: repeated ids
    and equal texts each keep their row. Other columns stay, ones called `runs` or `collapsed` are
    replaced.
    """
    shape = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"

    @F.arrow_udf(shape)
    @lean
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            flat, ends, texts = [], [0], []
            raw = batch.cast(pa.large_binary() if pa.types.is_large_string(batch.type) else pa.binary())
            for value in raw:
                words = (value.as_py() or b"").split()
                runs = runs_of(word_numbers(words), min_length, exponent) if len(words) >= min_length else []
                flat.extend(runs)
                ends.append(len(flat))
                texts.append(collapsed(words, runs))
            table = np.array(flat, dtype=np.int64).reshape(-1, 3)
            rows = pa.StructArray.from_arrays(
                [pa.array(table[:, i]) for i in range(3)], names=["start", "length", "period"]
            )
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)
            yield pa.StructArray.from_arrays(
                [lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["runs", "collapsed"]
            )

    found = free_name(docs, "found")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed")]
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.withColumn(found, find(value)).select(*kept, f"{found}.runs", f"{found}.collapsed")


#: Of an array `runs` by start and period, the run of the greatest length / period; the first of equals.
LONGEST = """aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (best, r) -> CASE
    WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)"""
