"""Collocations: phrases of two or three words that occur more often than their parts suggest.

The words of a language are one long row; a suffix is a pointer into it, read for `DEPTH` words or to the
end of its piece. A multikey three-way quicksort orders suffixes: it parts them by one word into less,
equal and greater, and goes on with the next word in the equal part only. The size of an equal part is
the number of times its phrase occurs.

1. Words are counted, with partial sums per task.
2. Each task sorts the suffixes of about a million words and sums equal ones, so that a phrase leaves a
   slice of text once, however often it is in it.
3. The sums are routed globally by leading words: by the first one, and where that is hot (a list of
   bounded length, from the exact counts) by the first two, where both are hot by all three. A pair is
   no more frequent than its rarer word, so no route gets more than a bounded share of the suffixes
   whose first words it has, and every phrase of three words is whole in its route.
4. Each route sorts what it got, abandons parts that are too rare as soon as their size is known, and
   gives back the phrases that are not. Only pairs of two hot words meet again, in a sum over routes.

Words are numbered within a block and travel as text, once per block; nothing is identified by a hash.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulon.llm.common import lean, stored
from tabulon.operators.lookup import lookup
from tabulon.operators.ordering import positions

DEPTH = 3
#: Words of text that are sorted at once, and suffixes a route should get.
SLICE_BYTES, ROUTE_SUFFIXES = 6 << 20, 2_000_000
#: A word is hot when it has more than this part of a route's fair share; more routes make no more hot words.
HOT_PART, MOST_HOT = 0.25, 16_384
#: Parts of fewer suffixes are sorted directly.
SMALL = 4096

#: What ends a piece becomes a byte that is in no text; A-Z become a-z and a tab a blank.
BREAK = b"\xff"
_ENDS = b".,;:!?\n\x0b\x0c\r"
_UPPER = bytes(range(0x41, 0x5B))
_CLEAN = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + BREAK * len(_ENDS) + b" ")


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of texts, with `BREAK` where a piece ends."""
    return BREAK.join(texts).translate(_CLEAN).replace(BREAK, b" \xff ").split()


def texts_by_language(batches, most: int = SLICE_BYTES) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) with about `most` bytes of text, or one text."""
    held, size = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            value = text.as_py()
            held[lang].append(value)
            size += len(value)
            if size >= most:
                yield from held.items()
                held, size = defaultdict(list), 0
    yield from held.items()


def multikey_quicksort(keys: np.ndarray, weight: np.ndarray, least: int = 1, hot: np.ndarray | None = None) -> np.ndarray:
    """Pointers to the columns of `keys` (one row per word of the suffix), in an order that puts equal ones together.

    An equal part whose `weight` is below `least` is abandoned, unless all its words so far are `hot`:
    then there may be more of it elsewhere.
    """
    out, stack = [], [(np.arange(keys.shape[1]), 0, True)]
    while stack:
        at, depth, all_hot = stack.pop()
        if depth == len(keys):
            out.append(at)
            continue
        if len(at) <= SMALL:
            out.append(at[np.lexsort(keys[depth:, at][::-1])])
            continue
        word = keys[depth, at]
        few = np.sort(word[:: len(word) // 64 + 1])
        pivot = few[len(few) // 2]
        equal = at[word == pivot]
        stack.append((at[word > pivot], depth, all_hot))
        still = all_hot and hot is not None and bool(hot[pivot])
        if least <= 1 or (still and depth + 1 < len(keys)) or weight[equal].sum() >= least:
            stack.append((equal, depth + 1, still))
        stack.append((at[word < pivot], depth, all_hot))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def parts(keys: np.ndarray, order: np.ndarray, weight: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted pointers, the first one of every equal part at a depth, and the part's size."""
    if not len(order):
        return order, order
    word = keys[:depth, order]
    begins = np.flatnonzero(np.concatenate([[True], (word[:, 1:] != word[:, :-1]).any(axis=0)]))
    return order[begins], np.add.reduceat(weight[order], begins)


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in texts_by_language(batches):
            counted = Counter(tokens(texts))
            counted.pop(BREAK, None)
            words = pa.array(list(counted), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words), pa.string()), words, pa.array(counted.values(), pa.int64())],
                names=["lang", "word", "n"],
            )

    counts = rows.mapInArrow(lean(run), "lang string, word string, n long")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def suffixes_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, and the distinct suffixes of two words or more as numbers of words, with how often each occurs.

    `BREAK` is word 0 and stands for the missing third word of a suffix that ends there.
    """
    number = defaultdict(count().__next__)
    number[BREAK]
    row = tokens(texts)
    ids = np.fromiter(map(number.__getitem__, row), np.int64, len(row))
    ids = np.concatenate([ids, np.zeros(DEPTH, dtype=np.int64)])
    at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
    keys = np.stack([ids[at + i] for i in range(DEPTH)])
    once = np.ones(len(at), dtype=np.int64)
    first, times = parts(keys, multikey_quicksort(keys, once), once, DEPTH)
    return list(number), keys[:, first], times


def routes_of(lang: str, words: list[bytes], keys: np.ndarray, hot: set, n: int) -> np.ndarray:
    """The route of every suffix: by its words up to the first that is not hot."""
    mark = np.array([zlib.crc32(w) for w in words], dtype=np.uint64)
    is_hot = np.array([(lang, w) in hot for w in words], dtype=bool)
    route = np.full(keys.shape[1], zlib.crc32(lang.encode()), dtype=np.uint64)
    more = np.ones(keys.shape[1], dtype=bool)
    for row in keys:
        step = (route ^ mark[row]) * np.uint64(0x9E3779B97F4A7C15)
        route = np.where(more, step ^ (step >> np.uint64(29)), route)
        more &= is_hot[row]
    return ((route >> np.uint64(16)) % np.uint64(n)).astype(np.int32)


BLOCK = "route int, lang string, words binary, suffixes binary, times binary"


def routed(rows: DataFrame, hot, n: int) -> DataFrame:
    """Blocks of suffixes: for each route, what a slice of text has for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in texts_by_language(batches):
            words, keys, times = suffixes_of(texts)
            route = routes_of(lang, words, keys, hot.value, n)
            order = np.argsort(route, kind="stable")
            own, begins = np.unique(route[order], return_index=True)
            blocks = []
            for at in np.split(order, begins[1:]) if len(own) else []:
                here = np.zeros(len(words), dtype=bool)
                here[0], here[keys[:, at]] = True, True
                used = np.flatnonzero(here)
                small = np.cumsum(here, dtype=np.int32) - 1
                blocks.append(
                    (b" ".join([words[i] for i in used]), small[keys[:, at]].tobytes(), times[at].astype(np.int32).tobytes())
                )
            if blocks:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array([lang] * len(own), pa.string()), *[pa.array(c, pa.binary()) for c in zip(*blocks)]],
                    names=["route", "lang", "words", "suffixes", "times"],
                )

    return rows.mapInArrow(lean(run), BLOCK)


def phrases(blocks: DataFrame, hot, least: int) -> DataFrame:
    """(lang, first, second, third, n, whole): what the routes count, from blocks; `third` is null for pairs.

    Pairs that are not `whole` are to be summed over routes.
    """

    def run(table: pa.Table) -> pa.Table:
        held = defaultdict(list)
        for lang, *block in zip(*[table.column(c).to_pylist() for c in ("lang", "words", "suffixes", "times")]):
            held[lang].append(block)
        found = []
        for lang, own in held.items():
            number = defaultdict(count().__next__)
            number[BREAK]
            keys, times = [], []
            for words, suffixes, n in own:
                ids = np.array([number[w] for w in words.split(b" ")], dtype=np.int32)
                keys.append(ids[np.frombuffer(suffixes, dtype=np.int32)].reshape(DEPTH, -1))
                times.append(np.frombuffer(n, dtype=np.int32))
            keys, times = np.concatenate(keys, axis=1), np.concatenate(times).astype(np.int64)
            words = list(number)
            is_hot = np.array([(lang, w) in hot.value for w in words], dtype=bool)
            order = multikey_quicksort(keys, times, least, is_hot)
            for depth in (2, 3):
                first, size = parts(keys, order, times, depth)
                whole = np.ones(len(first), dtype=bool) if depth == 3 else ~is_hot[keys[:2, first]].all(axis=0)
                keep = (size >= least) | ~whole
                if depth == 3:
                    keep &= keys[2, first] != 0
                first, size, whole = first[keep], size[keep], whole[keep]
                spelled = [pa.array([words[i] for i in row], pa.binary()).cast(pa.string()) for row in keys[:depth, first].tolist()]
                spelled += [pa.nulls(len(first), pa.string())] * (3 - depth)
                langs = pa.array([lang] * len(first), pa.string())
                found.append(pa.table([langs, *spelled, pa.array(size), pa.array(whole)], names=names))
        return pa.concat_tables(found) if found else pa.table([[]] * 6, names=names)

    names = ["lang", "first", "second", "third", "n", "whole"]
    counted = blocks.groupBy("route").applyInArrow(
        run, "lang string, first string, second string, third string, n long, whole boolean"
    )
    return counted


def phrase_counts(rows: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """(lang, first, second, third, n) of all phrases of two or three words with `least` occurrences, stored."""
    spark = rows.sparkSession
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROUTE_SUFFIXES))
    limit = max(total * HOT_PART / n, total / MOST_HOT)
    # At most total / limit <= MOST_HOT words.
    hot = {(r["lang"], r["word"].encode()) for r in words.where(F.col("n") > limit).collect()}
    shared = spark.sparkContext.broadcast(hot)
    counted = stored(phrases(routed(rows, shared, n), shared, least), "phrases")
    split = counted.where(~F.col("whole")).groupBy("lang", "first", "second").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return counted.where("whole").drop("whole").unionByName(split, allowMissingColumns=True)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, most: int = 2000, inside: int = 50
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `most` highest-scoring phrases of every language.

    `a` is how often the phrase occurs within pieces (between marks and line ends), `least` times or more;
    `l` and `r` are the numbers of the two parts it falls into where it scores least, the first such
    cut of equals; `n` is the number of words of the language. The score is floor(10^6 a a / (l r)), in exact
    arithmetic. A phrase is left out when a longer one that has all its words has `inside` percent of its
    occurrences. Equal scores are ordered by `a` (descending) and phrase (by bytes).

    A null language is called `und`, null and empty texts have no words, repeated rows count each
    time, other columns are ignored, and an empty table gives no rows.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.col(f"`{text}`").cast("string").cast("binary").alias("text"),
    ).where(F.length("text") > 0)
    words = stored(word_counts(rows), "words")
    found = stored(phrase_counts(rows, words, least), "phrases")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))

    # Every part of a frequent phrase is as frequent itself.
    known = words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("times"))
    pairs = found.where("third IS NULL").select("lang", F.concat_ws(" ", "first", "second").alias("part"), F.col("n").alias("times"))
    known = stored(known.unionByName(pairs), "parts")

    longer = found.where("third IS NOT NULL")
    holders = longer.select("lang", F.explode(F.array(F.struct("first", "second"), F.struct(F.col("second").alias("first"), F.col("third").alias("second")))).alias("p"), "n")
    holders = holders.groupBy("lang", F.concat_ws(" ", "p.first", "p.second").alias("phrase")).agg(F.max("n").alias("longer"))

    phrase = F.concat_ws(" ", "first", "second", "third").alias("phrase")
    cut = F.struct(F.lit(1).alias("k"), F.col("first").alias("left"), F.concat_ws(" ", "second", "third").alias("right"))
    late = F.struct(F.lit(2).alias("k"), F.concat_ws(" ", "first", "second").alias("left"), F.col("third").alias("right"))
    cuts = found.select("lang", phrase, F.col("n").alias("a"), F.explode(F.when(F.col("third").isNull(), F.array(cut)).otherwise(F.array(cut, late))).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.*")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = lookup(cuts.withColumnRenamed(side, "part"), known, ["lang", "part"], stored=True)
        cuts = cuts.drop("part").withColumnRenamed("times", name)
    exact = "cast(1000000 * cast(a AS decimal(16,0)) * cast(a AS decimal(16,0)) AS decimal(38,0)) div (cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)))"
    scored = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best")
    )
    scored = scored.join(holders, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))
    )
    ordered = scored.select("lang", "phrase", "a", "best.l", "best.r", "best.score", (-F.col("best.score")).alias("low"), (-F.col("a")).alias("few"))
    ranked = positions(ordered, ["lang"], ["low", "few", "phrase"], "rank").where(F.col("rank") <= most)
    return lookup(ranked, totals, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
