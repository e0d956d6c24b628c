"""Quality and toxicity: the fitted models against plain formulas, and held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tabulon.llm import quality, toxicity
from tabulon.llm.common import id_remainder, labelled
from tabulon.llm.queries import QUERIES

WIDE = "doc_id long, text string, label string, statistics string, score string, difference string, _id int"
TRAIN = "/root/testdata/sf0.01"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", 1) for i, t in rows], WIDE)


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for s in set(scores):
        at = np.array(scores) == s
        ranks[at] = ranks[at].mean()
    positive = np.array(labels) == 1
    n = positive.sum()
    return (ranks[positive].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_id_remainder_is_the_checksum_of_the_text(spark):
    rows = [(i,) for i in (0, 1, 17, 123456789, -5)] + [(None,)]
    got = spark.createDataFrame(rows, "doc_id long").select("doc_id", id_remainder("doc_id", 5).alias("r")).collect()
    for r in got:
        assert r["r"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5


def test_labels_may_be_null_repeated_or_out_of_range(spark):
    docs = wide(spark, [(1, "a"), (2, "b"), (3, "c"), (None, "d"), (5, None), (5, None)])
    labels = spark.createDataFrame(
        [(1, 0, "x"), (1, 1, "x"), (2, None, "x"), (3, 7, "x"), (None, 1, "x"), (5, 0, "x")], "doc_id long, quality int, text string"
    )
    got = sorted((r["doc_id"], r["label"]) for r in labelled(docs, labels, "quality").collect())
    assert got == [(1, 1), (5, 0), (5, 0)]


# --- Quality ----------------------------------------------------------------------------------------------------------


def test_discriminant_equals_the_density_formula(spark):
    rng = np.random.default_rng(4)
    k = len(quality.STATISTICS)
    rows = [(int(y), [float(v) for v in rng.standard_normal(k) + 0.5 * y]) for y in rng.integers(0, 2, 300)]
    model = quality.fit(spark.createDataFrame(rows, "label int, statistics array<double>"), shrinkage=0.2)
    x = np.array([v for _, v in rows])
    y = np.array([c for c, _ in rows])
    z = np.clip((x - x.mean(axis=0)) / x.std(axis=0), -quality.BOUND, quality.BOUND)
    pooled = sum((y == c).sum() * z[y == c].var(axis=0) for c in (0, 1)) / len(y)
    logs = []
    for c in (0, 1):
        n, part = (y == c).sum(), z[y == c]
        weight = 0.2 + 0.8 * k / (k + n)
        cov = (1 - weight) * np.cov(part.T, bias=True) + weight * np.diag(pooled) + 1e-3 * np.eye(k)
        off = z - part.mean(axis=0)
        far = np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off)
        logs.append(np.log(n + 1) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * far)
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    assert model.scores(x) == pytest.approx(want, abs=1e-9)


ODD = [None, "", " \n\t", "a", "word " * 50_000, "!" * 100_000, "日本語 \U0001f600", "\x00\x1c", "same", "same"]


def test_quality_of_odd_texts_and_without_labels(spark):
    docs = wide(spark, list(enumerate(ODD)))
    empty = quality.with_statistics(docs).where("doc_id < 0").withColumn("label", quality.F.lit(1))
    model = quality.fit(empty)
    rows = quality.with_scores(docs, model).collect()
    assert {r["score"] for r in rows} == {0.5} and {r["predicted"] for r in rows} == {1}
    one = quality.fit(quality.with_statistics(docs).withColumn("label", quality.F.lit(1)))
    rows = quality.with_scores(docs, one).orderBy("doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[0]["score"] == rows[1]["score"]
    assert quality.with_scores(docs.where("doc_id < 0"), one).collect() == []


def held_out(spark, name, label):
    rows = QUERIES[name](spark, TRAIN).collect()
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{TRAIN}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{TRAIN}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    return [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]


def test_quality_on_rows_that_were_held_out(spark):
    rows = held_out(spark, "op6_quality", "quality")
    assert auc([r[0] for r in rows], [r[1] for r in rows]) > 0.97
    assert np.mean([r[0] == r[2] for r in rows]) > 0.95


# --- Toxicity ---------------------------------------------------------------------------------------------------------


def plain_difference(rows, text):
    """Interpolated Kneser-Ney by its formulas, with dictionaries, for a text of known and unknown words."""
    order, discount = toxicity.ORDER, toxicity.DISCOUNT
    counts = [Counter(), Counter()]
    for t, label in rows:
        for w in toxicity.words_of(t):
            counts[label].update(toxicity.grams_of(w))
    types = set(counts[0]) | set(counts[1])
    levels = {order: types}
    for size in range(order - 1, 0, -1):
        levels[size] = {g[1:] for g in levels[size + 1]}
    contexts = {size: Counter(g[1:] for g in levels[size + 1]) for size in range(1, order)}

    def shared(gram):
        if not gram:
            return 1 / len({g[-1] for g in types})
        same = {g: n for g, n in contexts[len(gram)].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        if not total:
            return shared(gram[1:])
        return (max(same.get(gram, 0) - discount, 0) + discount * len(same) * shared(gram[1:])) / total

    def chance(k, gram):
        same = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        total = sum(same.values())
        below = shared(gram[1:])
        return (max(same.get(gram, 0) - discount, 0) + discount * len(same) * below) / total if total else below

    share = toxicity.TOXIC_SHARE
    each = []
    for w in toxicity.words_of(text):
        odds = sum(math.log(chance(1, g)) - math.log(chance(0, g)) for g in toxicity.grams_of(w))
        each.append(math.log(1 - share + share * math.exp(odds)))
    return sum(each) / len(each)


def test_differences_equal_the_plain_formulas(spark):
    rows = [("the cat sat on the mat", 0), ("a cat and a dog", 0), ("you idiot cat, you fool", 1), ("idiots and fools sat", 1)]
    model = toxicity.count_models(spark.createDataFrame(rows, "text string, label int"))
    for text in ["the idiot", "cats sat idiotic", "dog dog you", "zebra xylophone", "a"]:
        assert model.differences([text])[0] == pytest.approx(plain_difference(rows, text), abs=1e-9)


def test_toxicity_of_odd_texts_and_without_labels(spark):
    docs = wide(spark, list(enumerate(ODD)))
    none = toxicity.count_models(spark.createDataFrame([], "text string, label int"))
    none = toxicity.calibrate(none, spark.createDataFrame([], "doc_id long, text string, label int"))
    rows = toxicity.with_scores(docs, none).orderBy("doc_id").collect()
    assert [r["score"] for r in rows] == [0.5] * len(ODD)
    one = toxicity.count_models(spark.createDataFrame([("only ordinary words", 0), (None, 0)], "text string, label int"))
    rows = toxicity.with_scores(docs, one).orderBy("doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[8]["score"] == rows[9]["score"]
    assert rows[0]["difference"] == rows[1]["difference"] == rows[2]["difference"] == 0
    assert toxicity.with_scores(docs.where("doc_id < 0"), one).collect() == []


def test_no_counted_sequence_is_dropped(spark):
    letters = np.array(list("abcdefghijklmnop"))
    words = ["".join(w) for w in letters[np.random.default_rng(8).integers(0, 16, (90_000, 8))]]
    rows = [(" ".join(words[i::40]), i % 2) for i in range(40)]
    model = toxicity.count_models(spark.createDataFrame(rows, "text string, label int"))
    want = {g for w in words for g in toxicity.grams_of(w)}
    assert len(want) > 400_000 and model.grams.count() == len(want)


def test_words_that_are_not_loaded_get_the_same_difference(spark, monkeypatch):
    rows = [("the cat sat on the mat", 0), ("a cat and a dog", 0), ("you idiot cat, you fool", 1), ("idiots and fools sat", 1)]
    texts = ["the idiot", "cats sat idiotic idiotic", "zebra xylophone", "", None, "the idiot"]
    table = spark.createDataFrame(rows, "text string, label int")
    loaded = toxicity.count_models(table).differences(texts)
    for most in (0, 12, 40):  # nothing is loaded, or some contexts are
        monkeypatch.setattr(toxicity, "MEMO_GRAMS", most)
        model = toxicity.count_models(table)
        assert len(model.loaded.grams) <= most and model.loaded.others is not None
        assert model.differences(texts) == pytest.approx(loaded, abs=1e-12)


def test_large_odds_are_exact():
    odds = np.array([-700.0, -1.0, 0.0, 1.0, 29.0, 39.9, 40.1, 500.0])
    want = [math.log1p(-0.01 + 0.01 * math.exp(x)) for x in odds]
    assert toxicity.difference_of(odds) == pytest.approx(want, abs=1e-12)


def test_toxicity_on_rows_that_were_held_out(spark):
    rows = QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1").collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert auc([r[0] for r in rows], [r[1] for r in rows]) > 0.95
    assert np.mean([r[0] == r[2] for r in rows]) > 0.95
