"""Collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tabulon.llm import collocations as C

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, most=2000):
    counts, out = {}, []
    for text, lang in rows:
        c = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    for lang, c in counts.items():
        n, found = sum(v for p, v in c.items() if len(p) == 1), []
        longer = Counter()
        for p, v in c.items():
            if len(p) == 3 and v >= least:
                for q in (p[:2], p[1:]):
                    longer[q] = max(longer[q], v)
        for p, a in c.items():
            if len(p) > 1 and a >= least and not (100 * longer[p] >= 50 * a and longer[p]):
                score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["a", "The", "of", "new", "york", "City", "ñu", "don't", "x\x1fy", " ", "z" * 40]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ";"]) for _ in range(n))
    out = [(text(rng.randrange(120)), rng.choice(["en", "en", "en", "de", None])) for _ in range(80)]
    out += [(None, "en"), ("", "en"), (" .,\n", "fr"), ("hot pair " * 3000, "en"), ("one two three. " * 15, "und")]
    return out + [out[0]] * 12 + [("b c d e " * 12, "es"), ("word " * 30, "it")]


def collected(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("part, bytes_", [(0.25, 6 << 20), (0.0, 2000)])
def test_matches_brute_force(spark, rows, monkeypatch, part, bytes_):
    """Also when nearly all words are hot and a text is many slices."""
    monkeypatch.setattr(C, "HOT_PART", part)
    monkeypatch.setattr(C, "MOST_HOT", 16_384 if part else 200)
    by_slice = C.texts_by_language
    monkeypatch.setattr(C, "texts_by_language", lambda batches: by_slice(batches, bytes_))
    docs = spark.createDataFrame(rows, "text string, lang string").withColumnRenamed("text", "body")
    docs = docs.selectExpr("*", "1 AS n", "2 AS score").repartition(5)
    assert collected(C.collocations(docs, "body")) == brute(rows)


def test_limits_and_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert collected(C.collocations(docs, least=25, most=3)) == brute(rows, 25, 3)
    assert C.collocations(docs.where("lang = 'none'")).count() == 0


@given(st.lists(st.tuples(*[st.integers(0, 4)] * 3, st.integers(1, 9)), min_size=1, max_size=200), st.integers(1, 12))
@settings(max_examples=100, deadline=None)
def test_quicksort_puts_equal_suffixes_together_and_abandons_rare_ones(rows, least):
    table = np.array(rows).T
    keys, weight = table[:3], table[3]
    small, C.SMALL = C.SMALL, 4
    try:
        order = C.multikey_quicksort(keys, weight, least)
    finally:
        C.SMALL = small
    for depth in (1, 2, 3):
        want = Counter()
        for r in rows:
            want[r[:depth]] += r[3]
        first, size = C.parts(keys, order, weight, depth)
        got = dict(zip(map(tuple, keys[:depth, first].T.tolist()), size.tolist()))
        frequent = {k: v for k, v in want.items() if v >= least}
        assert len(got) == len(first)
        if depth == 3:
            assert {k: v for k, v in got.items() if v >= least} == frequent


def test_tokens_cut_at_marks_only():
    assert C.tokens(["A b.C\x0bd\te".encode(), "É, f".encode()]) == [
        b"a", b"b", C.BREAK, b"c", C.BREAK, b"d", b"e", C.BREAK, "É".encode(), C.BREAK, " f".encode()
    ]


def test_routes_depend_on_the_words_up_to_the_first_that_is_not_hot():
    words = [C.BREAK, b"hot", b"warm", b"cold", b"ice"]
    keys = np.array([[3, 3, 1, 1, 1, 1], [1, 4, 3, 3, 2, 2], [2, 4, 2, 4, 3, 4]])
    route = C.routes_of("en", words, keys, {("en", b"hot"), ("en", b"warm")}, 1 << 30)
    assert route[0] == route[1] and route[2] == route[3] and route[4] != route[5]
    assert len(set(route.tolist())) == 4
    assert (C.routes_of("de", words, keys, set(), 1 << 30)[2:] == C.routes_of("de", words, keys, set(), 1 << 30)[2]).all()


def test_texts_are_taken_in_slices():
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b", "a"], "text": [b"x" * 6, b"y" * 6, b"z"]})
    assert list(C.texts_by_language([batch], 10)) == [("a", [b"x" * 6]), ("b", [b"y" * 6]), ("a", [b"z"])]
