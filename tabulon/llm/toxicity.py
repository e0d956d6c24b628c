"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary texts, give each word the probability of its characters, each
after the seven before it. Most words of a toxic text are ordinary, so there a word comes from the
ordinary model but for a share of `TOXIC_SHARE`, which comes from the toxic one. A text's log
likelihoods under both readings are divided by its number of words and compared. At the highest order, counts are those of the class; what the discount takes away goes to
lower orders whose continuation counts (in how many contexts was this seen) are shared by both
classes, so an expression too rare to tell falls back on the same numbers in both models. Working on
characters rather than whole words lets unseen inflections of a toxic stem count as well.

A logistic curve, fitted on labelled texts that were not counted, turns the difference into a score.

Counting covers all labelled texts given. All sequences are kept, in stored tables that grow with
the texts: continuation counts, probabilities and differences are aggregations and joins. Workers load
the sequences of the contexts seen most, `MEMO_GRAMS` at most, and a Bloom filter of all other contexts, of
bounded size. A word whose contexts are loaded or certainly unseen is scored where it is read. The others
are set aside, scored once each by joining their sequences to the tables, and joined back, so what is
loaded changes the cost and not the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.llm.common import MEMO_ENTRIES, lean, portions, stored
from tabulon.llm.decontamination import Filter, mixed
from tabulon.operators.lookup import lookup

WORD = re.compile(r"\w+")
ORDER = 8
TOXIC_SHARE = 0.01
BEGIN, END = "\x02", "\x03"
DISCOUNT = 0.75
#: Sequences a worker loads, at 24 bytes each; the memory this takes does not grow with the corpus.
MEMO_GRAMS = 2_500_000
#: Above this the rest of log(1 + x) is below the last digit.
LARGE = 40.0


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def padded(word: str) -> str:
    return BEGIN * (ORDER - 1) + word + END


def grams_of(word: str) -> list[str]:
    text = padded(word)
    return [text[i : i + ORDER] for i in range(len(text) - ORDER + 1)]


_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)) for i in range(ORDER)]


def hashes(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sequences of characters that begin `at`, the hash of the context and that of the whole."""
    context = np.zeros(len(at), dtype=np.uint64)
    for i in range(ORDER - 1):
        context += (codes[at + i] + np.uint64(1)) * _FACTORS[i]
    return mixed(context ^ np.uint64(1)), mixed(context + (codes[at + ORDER - 1] + np.uint64(1)) * _FACTORS[-1])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def difference_of(odds: np.ndarray) -> np.ndarray:
    """Of a word's log odds, what it adds to the text's: it is from the toxic model with `TOXIC_SHARE`."""
    low = np.log1p(TOXIC_SHARE * np.expm1(np.minimum(odds, LARGE)))
    return np.where(odds > LARGE, odds + np.log(TOXIC_SHARE), low)


class Loaded:
    """The sequences and contexts a worker has, as sorted hashes, and a filter of the contexts it has not."""

    def __init__(self, table: pa.Table, others: Filter | None):
        columns = [table.column(c).to_numpy() for c in ("gram", "context", "value", "backoff")]
        gram, context = (c.view(np.uint64) for c in columns[:2])
        order = np.argsort(gram)
        self.grams, self.values = gram[order], columns[2][order]
        self.contexts, first = np.unique(context, return_index=True)
        self.backoffs, self.others = columns[3][first], others

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def differences(self, words: list[str]) -> list[float | None]:
        """Of each word; None where it takes sequences that are not loaded."""
        if not words:
            return []
        sizes = np.array([len(w) + 1 for w in words])
        begin = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
        owner = np.repeat(np.arange(len(words)), sizes)
        at = begin[owner] + np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
        context, gram = hashes(codes_of("".join(map(padded, words))), at)
        i, counted = self._find(self.grams, gram)
        j, known = self._find(self.contexts, context)
        odds = np.zeros(len(owner))
        odds[known] = self.backoffs[j[known]]
        odds[counted] = self.values[i[counted]]
        found = difference_of(np.bincount(owner, odds, len(words))).tolist()
        if self.others is not None:
            for k in np.unique(owner[~known][self.others.may_have(context[~known])]).tolist():
                found[k] = None
        return found


def hashed(grams: DataFrame) -> DataFrame:
    """`gram, context, value, backoff` with hashes in place of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = codes_of("".join(batch.column(0).to_pylist()))
            context, gram = hashes(codes, np.arange(0, len(codes), ORDER))
            columns = [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), batch.column(1), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "context", "value", "backoff"])

    return grams.select("gram", "value", "backoff").mapInArrow(run, "gram long, context long, value double, backoff double")


class Comparison:
    """Log-likelihood differences (toxic minus ordinary) of all sequences, as a stored table.

    `grams` has the columns gram, context, value, backoff and seen (of the context); `loaded` has what
    workers load of it.
    """

    def __init__(self, grams: DataFrame):
        self.grams = grams
        cut = _cutoff(grams, "seen", MEMO_GRAMS)
        rest = grams.where(F.col("seen") < cut)
        others = None
        if not rest.isEmpty():
            contexts = hashed(rest).select(F.col("context").alias("fingerprint"))
            others = Filter(stored(contexts.distinct(), "contexts"))
        self.loaded = Loaded(hashed(grams.where(F.col("seen") >= cut)).toArrow(), others)
        self.slope, self.bias = 1.0, 0.0

    def word_differences(self, words: DataFrame) -> DataFrame:
        """(word, difference) of a stored table of distinct words, by joins."""
        text = F.concat(F.lit(BEGIN * (ORDER - 1)), "word", F.lit(END))
        at = F.sequence(F.lit(1), F.length("word") + 1)
        each = words.select("word", F.explode(F.transform(at, lambda i: F.substring(text, i, F.lit(ORDER)))).alias("gram"))
        # Every sequence once, so that no key is hot on either side; a context has at most one per character.
        grams = each.select("gram").distinct().withColumn("context", F.substring("gram", 1, ORDER - 1))
        contexts = self.grams.groupBy("context").agg(F.first("backoff").alias("backoff"))
        odds = (
            grams.join(self.grams.select("gram", "value"), "gram", "left")
            .join(contexts, "context", "left")
            .select("gram", F.coalesce("value", "backoff").alias("odds"))
            .where("odds IS NOT NULL")
        )
        summed = lookup(each, odds, ["gram"]).groupBy("word").agg(F.coalesce(F.sum("odds"), F.lit(0.0)).alias("odds"))
        low = F.log1p(TOXIC_SHARE * F.expm1(F.least("odds", F.lit(LARGE))))
        difference = F.when(F.col("odds") > LARGE, F.col("odds") + math.log(TOXIC_SHARE)).otherwise(low)
        return stored(summed.select("word", difference.alias("difference")), "word-differences")

    def differences(self, texts) -> list[float]:
        """The difference per word of each of a few texts; 0 for a text without words."""
        rows = self.grams.sparkSession.createDataFrame(list(enumerate(texts)), "at long, text string")
        return [r["difference"] for r in with_difference(rows, self).orderBy("at").collect()]


def _cutoff(counts: DataFrame, column: str, most: int, least: int = 1) -> int:
    """The smallest count, `least` or more, that at most `most` rows reach."""
    sizes = counts.groupBy(F.least(F.col(column), F.lit(1_000_000)).alias("c")).agg(F.count("*").alias("n")).collect()
    kept, cut = 0, 1_000_001
    for r in sorted(sizes, reverse=True):
        if r["c"] < least or kept + r["n"] > most:
            break
        kept, cut = kept + r["n"], r["c"]
    return cut


def _summed(rows: DataFrame, run, name: str) -> DataFrame:
    return (
        rows.mapInPandas(run, f"{name} string, n0 long, n1 long")
        .groupBy(name)
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n0, n1): how often a word is in the texts of each label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted = {0: Counter(), 1: Counter()}
            for text, label in zip(batch["text"], batch["label"]):
                counted[label].update(words_of(text))
            words = list(counted[0].keys() | counted[1].keys())
            if words:
                yield pd.DataFrame({"word": words, **{f"n{k}": [counted[k][w] for w in words] for k in (0, 1)}})

    return _summed(rows.select("text", "label"), run, "word")


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, n0, n1) of the character sequences in counted words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counted: dict[str, list[int]] = {}
            for word, a, b in zip(batch["word"], batch["n0"].tolist(), batch["n1"].tolist()):
                for g in grams_of(word):
                    n = counted.setdefault(g, [0, 0])
                    n[0] += a
                    n[1] += b
            if counted:
                table = np.array(list(counted.values()), dtype=np.int64)
                yield pd.DataFrame({"gram": list(counted), "n0": table[:, 0], "n1": table[:, 1]})

    return _summed(words, run, "gram")


def _before(gram: str) -> Column:
    return F.expr(f"left({gram}, length({gram}) - 1)")


def shared_probabilities(grams: DataFrame) -> DataFrame:
    """(ending, lower): the Kneser-Ney probability of the last character of every sequence without its first character.

    It comes from the lower orders, whose counts are of distinct longer sequences. A context has no more
    rows than there are characters.
    """
    levels, longer = {}, grams.select("gram")
    for size in range(ORDER - 1, 0, -1):
        ending = F.substring("gram", 2, ORDER).alias("gram")
        levels[size] = longer = stored(longer.groupBy(ending).agg(F.count("*").alias("n")), f"endings-{size}")
    total, kinds = levels[1].agg(F.sum("n"), F.count("*")).first()
    lower = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0))
    below = levels[1].select(
        F.col("gram").alias("ending"), ((lower + DISCOUNT * kinds / max(kinds, 1)) / (total or 1)).alias("lower")
    )
    for size in range(2, ORDER):
        same = Window.partitionBy("before")
        level = levels[size].select("gram", "n", _before("gram").alias("before"), F.substring("gram", 2, ORDER).alias("ending"))
        level = level.withColumns({"total": F.sum("n").over(same), "kinds": F.count("*").over(same)})
        below = level.join(below, "ending").select(
            F.col("gram").alias("ending"), ((lower + DISCOUNT * F.col("kinds") * F.col("lower")) / F.col("total")).alias("lower")
        )
    return below


def count_models(rows: DataFrame) -> Comparison:
    """The comparison counted from all `rows` (text, label 0 or 1); every sequence is kept."""
    counts = stored(gram_counts(word_counts(rows)), "grams")
    same = Window.partitionBy("context")
    each = counts.select("gram", "n0", "n1", F.substring("gram", 1, ORDER - 1).alias("context"))
    for k in (0, 1):
        of, kinds = F.sum(f"n{k}").over(same), F.sum((F.col(f"n{k}") > 0).cast("int")).over(same)
        each = each.withColumn(f"of{k}", of).withColumn(f"kinds{k}", kinds)
    each = each.withColumn("ending", F.substring("gram", 2, ORDER)).join(shared_probabilities(counts), "ending")
    logs, weights = [], []
    for k in (0, 1):
        of = F.greatest(F.col(f"of{k}"), F.lit(1))
        weights.append(F.when(F.col(f"of{k}") > 0, DISCOUNT * F.col(f"kinds{k}") / of).otherwise(F.lit(1.0)))
        logs.append(F.log(F.greatest(F.col(f"n{k}") - DISCOUNT, F.lit(0.0)) / of + weights[k] * F.col("lower")))
    differences = each.select(
        "gram", "context", (logs[1] - logs[0]).alias("value"), (F.log(weights[1]) - F.log(weights[0])).alias("backoff"),
        (F.col("of0") + F.col("of1")).alias("seen"),
    )
    return Comparison(stored(differences, "differences"))


def calibrate(model: Comparison, rows: DataFrame, max_rows: int = 20_000, order: str = "doc_id") -> Comparison:
    """Fit the logistic curve on at most `max_rows` rows (first in hash order) that were not counted."""
    chosen = rows.orderBy(F.xxhash64(order), order).limit(max_rows)
    chosen = stored(chosen.select("text", "label"), "calibration")
    found = with_difference(chosen, model).select("difference", "label").toPandas()
    x, y = found["difference"].to_numpy(float), found["label"].to_numpy(float)
    if len(set(y)) < 2:
        return model
    spread = x.std() or 1.0
    design = np.stack([x / spread, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (p - y) + 1e-2 * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.bias = float(beta[0] / spread), float(beta[1])
    return model


def with_difference(docs: DataFrame, model: Comparison, text: str = "text") -> DataFrame:
    """Adds `difference`, the log-likelihood difference per word of the whole text.

    Equal texts are looked up once, by a digest of theirs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.loaded)

    @F.pandas_udf("struct<total:double,words:long,rest:array<string>,times:array<long>>")
    @lean
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float | None] = {}
        for batch in batches:
            rows = []
            for part in portions(batch):
                texts = [words_of(t) for t in part]
                if len(known) > MEMO_ENTRIES:
                    known.clear()
                new = [w for w in set().union(*texts) if w not in known]
                known.update(zip(new, shared.value.differences(new)))
                for words in texts:
                    found = [known[w] for w in words]
                    rest = Counter(w for w, d in zip(words, found) if d is None) if None in found else {}
                    total = sum([d for d in found if d is not None] if rest else found)
                    rows.append((float(total), len(words), list(rest), list(rest.values())))
            yield pd.DataFrame(rows, columns=["total", "words", "rest", "times"])

    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.drop("difference").withColumn("_text_key", F.unhex(F.md5(value.cast("binary"))))
    parts = keyed.select("_text_key", measure(value).alias("m")).select("_text_key", "m.*")
    parts = stored(parts, "measured")
    once = parts.where(F.size("rest") > 0).groupBy("_text_key").agg(F.first(F.struct("rest", "times")).alias("m"))
    rest = stored(once.select("_text_key", F.inline(F.arrays_zip("m.rest", "m.times"))).toDF("_text_key", "word", "times"), "rest")
    scored = model.word_differences(stored(rest.select("word").distinct(), "rest-words"))
    more = lookup(rest, scored, ["word"], stored=True).groupBy("_text_key").agg(
        F.sum(F.col("times") * F.col("difference")).alias("more")
    )
    texts = parts.groupBy("_text_key").agg(F.max("total").alias("total"), F.max("words").alias("words"))
    per_word = (F.col("total") + F.coalesce("more", F.lit(0.0))) / F.col("words")
    found = texts.join(more, "_text_key", "left").select(
        "_text_key", F.when(F.col("words") > 0, per_word).otherwise(F.lit(0.0)).alias("difference")
    )
    return lookup(keyed, found, ["_text_key"]).drop("_text_key")


def with_scores(docs: DataFrame, model: Comparison, text: str = "text") -> DataFrame:
    """Adds `difference`, `score` and `predicted`; columns of those names are replaced.

    A null text counts as empty; a text without words has difference 0 and the score that goes with it.
    """
    odds = F.col("difference") * model.slope + model.bias
    return (
        with_difference(docs, model, text)
        .withColumn("score", 1 / (1 + F.exp(-odds)))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )
