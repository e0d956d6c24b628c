"""Benchmark windows in documents, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import decontamination, queries
from tabulon.llm.decontamination import Filter, benchmark_windows, contamination, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i : i + size]))
                if owners:
                    hit |= set(range(i, i + size))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    vocabulary = ["a", "B", "ñandú", "x9", "7", "Œ", "the", "of", "зима"]
    text = lambda n: rng.choice([" ", "-", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randrange(1, 40))) for i in range(60)]
    items += [(7, text(12)), (None, text(15)), (100, None), (101, ""), (102, "?!"), (103, items[3][1]), (104, "lonely pair")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(150)]
    for i in range(60):
        part = words(items[i][1])
        docs.append((200 + i, " ".join(words(text(5)) + part[2:] + words(text(7)) + part[: rng.randrange(9, 14)])))
    docs += [(None, items[5][1]), (1, items[6][1].upper()), (1, items[6][1].upper()), (400, None), (401, ""), (402, "...")]
    docs += [(403, " ".join(["of the"] * 5000) + " " + items[9][1] + " z" * 5000), (404, "a lonely  PAIR here")]
    return docs, items


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_query_matches_brute_force(spark, tables, monkeypatch, limit):
    docs, items = tables
    frames = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string"),
        "benchmark": spark.createDataFrame(items, "item_id long, text string"),
    }
    monkeypatch.setattr(queries, "table", lambda _, __, name: frames[name])
    join = decontamination.lookup
    monkeypatch.setattr(decontamination, "lookup", lambda df, t, keys, **_: join(df, t, keys, limit))
    got = queries.QUERIES["op11_decontamination"](spark, "")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_spans_items_and_other_columns(spark):
    shared = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame(
        [("x", f"zero {shared} twelve", 1, "h", "k"), ("y", "nothing of it", 2, "h", "k"), ("z", None, 3, "h", "k")],
        "id string, body string, n_hit int, _hits string, `_Text_Key` string",
    )
    items = spark.createDataFrame([("q2", f"{shared} other"), ("q10", shared)], "q string, t string")
    rows = {r["id"]: r for r in contamination(docs, items, "body", "q", "t").collect()}
    assert [tuple(s) for s in rows["x"]["spans"]] == [(1, 12)] and rows["x"]["items"] == ["q10", "q2"]
    assert rows["x"]["n_hit"] == 11 and rows["x"]["_hits"] == "h" and rows["x"]["_Text_Key"] == "k"
    assert not rows["y"]["contaminated"] and rows["z"]["n_words"] == 0 and rows["z"]["items"] == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert contamination(docs, items.where("item_id > 1")).first()["contaminated"] is False
    assert contamination(docs.where("doc_id > 1"), items).count() == 0
    assert contamination(docs, items).first()["n_hit"] == 2


def test_words_at_the_ends_of_texts_and_blocks(monkeypatch):
    texts = ["ab", "cd ef", "", None, "gh", "é" * 700 + " tail", "x" * 3000]
    plain = words_of(pa.array(texts))
    assert np.diff(plain.bounds).tolist() == [1, 2, 0, 0, 1, 2, 1]
    again = words_of(pa.array(["cd", "tail", "gh ab"]))
    same = dict(zip(["cd", "tail", "gh", "ab"], again.hash.tolist()))
    assert [plain.hash[i] for i in (1, 5, 3, 0)] == [same[w] for w in ("cd", "tail", "gh", "ab")]
    monkeypatch.setattr(decontamination, "BLOCK", 512)
    small = words_of(pa.array(texts))
    assert small.hash[:4].tolist() == plain.hash[:4].tolist() and small.hash[5] == plain.hash[5]


def test_every_shared_window_has_a_fingerprint_in_common_and_most_windows_share_theirs():
    rng = np.random.default_rng(0)
    left, right = (" ".join(map(str, rng.integers(0, 10**6, 400))) for _ in "ab")
    shared = " ".join(map(str, rng.integers(0, 10**6, 10)))
    one, two = words_of(pa.array([f"{left} {shared} {right}"])), words_of(pa.array([f"{right} {shared}"]))
    assert set(one.fingerprints(10).tolist()) & set(two.fingerprints(10)[-1:].tolist())
    assert len(set(one.fingerprints(10).tolist())) < 0.4 * len(one.hash)


def test_the_filter_loses_no_fingerprint(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(300)], "item_id long, text string")
    windows = benchmark_windows(items, "item_id", "text").select("fingerprint").distinct()
    prints = np.array([r[0] for r in windows.collect()], dtype=np.int64).view(np.uint64)
    known = Filter(windows)
    assert known.may_have(prints).all()
    other = np.random.default_rng(1).integers(0, 1 << 63, 100_000).astype(np.uint64) * np.uint64(2)
    assert known.may_have(other).mean() < 0.001
