"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tabulon.llm import queries
from tabulon.llm.periodic_runs import bands, runs_of, with_runs, word_numbers

WORD = r"[^\x20\x09-\x0D]+"


def brute_runs(words):
    """Every stretch that is maximal for its period, kept when no shorter period fits it."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        start = 0
        while start < n - q:
            end = start
            while end < n - q and words[end] == words[end + q]:
                end += 1
            length = end + q - start
            if end > start and length >= max(6, 4 * q):
                part = words[start : start + length]
                if not any(all(part[i] == part[i + d] for i in range(length - d)) for d in range(1, q)):
                    found.add((start, length, q))
            start = max(end, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    import re

    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


@given(st.lists(st.integers(0, 2), max_size=60))
@settings(max_examples=400, deadline=None)
def test_short_alphabets_match_brute_force(words):
    assert runs_of(word_numbers([b"%d" % w for w in words])) == brute_runs(words)


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 9), st.integers(0, 11)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_planted_repetitions_match_brute_force(parts):
    words = [w for unit, times, more in parts for w in unit * times + unit[:more]]
    assert runs_of(word_numbers([b"%d" % w for w in words])) == brute_runs(words)


def test_units_whose_short_grams_all_occur_twice():
    """Every 5-gram of the unit is in it twice, so only longer grams show its period."""
    rng = random.Random(1)
    follow = {i: [i * 2 % 16, (i * 2 + 1) % 16] * 2 for i in range(16)}  # doubled graph of 4-grams
    for v in follow.values():
        rng.shuffle(v)
    path, stack = [], [0]
    while stack:
        if follow[stack[-1]]:
            stack.append(follow[stack[-1]].pop())
        else:
            path.append(stack.pop())
    unit = [v & 1 for v in path[::-1][1:]]
    assert len(unit) == 64
    words = unit * 5 + [7] + unit * 4
    assert runs_of(word_numbers([b"%d" % w for w in words])) == brute_runs(words)


def test_one_word_through_a_long_text_is_extended_once():
    assert runs_of(word_numbers([b"a"] * 300_000)) == [(0, 300_000, 1)]
    unit = [b"%d" % i for i in range(1000)]
    assert runs_of(word_numbers(unit * 300)) == [(0, 300_000, 1000)]


def test_bands_cover_all_lags_with_guaranteed_overlap():
    low = 0
    for k, first, last in bands(5000):
        assert first == low + 1 and all(last <= k <= max(6 - q, 3 * q) for q in range(first, last + 1)) or last <= 2
        low = last
    assert low * 4 * 2 > 5000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    word = lambda: rng.choice(["ab", "Ab", "é", "x.", " ", "\x1f", "zz"])
    out = [None, "", " \t\n", "one", "a " * 5, "a " * 6, "a b\ta b\na b a  b", "a b a b a b a", "a b a b"]
    out += [" ".join(word() for _ in range(rng.randrange(80))) for _ in range(120)]
    return out + [out[5], out[5], "p q r " * 400, " ".join(map(str, range(3000))) + " " + "w " * 9]


def test_query_matches_brute_force(spark, texts, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts)] + [(10**7 + i, t) for i, t in enumerate(texts)]
    rows += [(None, "a b c a b c a b c a b c"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.QUERIES["op13_periodic_runs"](spark, "")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted((brute_row(*r) for r in rows), key=key)


def test_whole_table_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()}
    short = [r for r in docs if len(r["text"] or "") < 4000]
    assert len(got) == len(docs) and {r["doc_id"]: brute_row(*r) for r in short}.items() <= got.items()


def test_other_columns_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b", "r", "f", "c")], "id int, text string, runs string, found string, collapsed string")
    got = with_runs(docs)
    assert got.columns == ["id", "text", "found", "runs", "collapsed"]
    row = got.first()
    assert row["found"] == "f" and row["collapsed"] == "a b" and [tuple(r) for r in row["runs"]] == [(0, 6, 1)]
    assert with_runs(docs.where("id > 1")).count() == 0
    assert with_runs(docs.select(F.lit(None).cast("string").alias("text"))).first()["collapsed"] == ""
