"""Personal data against the patterns as written and brute-force decoding; the pipeline on planted cases."""

import hashlib
import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from tabulon.llm import pii
from tabulon.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        d = [int(x) for x in s[::-1]]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


TEXTS = [
    "", "nothing here", "a@b.c and x@y and p@q.r@s.t, é.f@g-h.i..j", "@a.b c@@d.e %+-@x.y-.z",
    "1.2.3.4.5 256.1.1.1 001.002.003.004 1.2.3 9.9.9.9.9.9.9.9", "4111 1111 1111 1111 and 4111-1111-1111-1112, 0",
    "+1 (212) 555-0188 +12345678 ++49 30 5550123- +1..........2", "日本 a@b.co \U0001f600 10.0.0.1",
    "+1 (269) 555-3296 4524132264652876", "7" * 300 + "." + "8" * 300, "a" * 400 + "@",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_of_random_texts():
    rng = np.random.default_rng(6)
    for _ in range(1500):
        text = "".join(rng.choice(list("a1@.+- ()234%é\n"), rng.integers(1, 60)))
        assert pii.base_spans(text) == plain_base(text)


def test_long_words_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a.@" * 100_000, "+1 " * 100_000, "@" * 300_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_decoding_finds_the_best_states(field):
    for text in ["call +1 5", "a@b.c", "ip 1.2.3", "key=ab12"]:
        seq = pii.tokens(text)
        emit = field.scores(field.features(seq))
        moves = field.next + pii._FORBIDDEN
        n, k = len(seq.shapes), len(pii.STATES)
        best = max(
            (
                emit[range(n), path].sum() + pii._FORBIDDEN[0, path[0]] + sum(moves[a, b] for a, b in zip(path, path[1:])),
                path,
            )
            for path in map(list, itertools.product(range(k), repeat=min(n, 5)))
            if n <= 5
        ) if n <= 5 else None
        states = field.decode([seq])[0]
        score = emit[range(n), states].sum() + pii._FORBIDDEN[0, states[0]] + moves[states[:-1], states[1:]].sum()
        assert best is None or score == pytest.approx(best[0])
        assert np.isfinite(score)


def test_batches_decode_like_single_sequences(field):
    parts = [pii.tokens(t) for t in TEXTS if t] + [pii.labelled_sequence(e)[0] for e in pii.EXAMPLES]
    for one, many in zip([field.decode([s])[0] for s in parts], field.decode(parts, batch=7)):
        assert (one == many).all()


def test_the_field_learns_its_table_and_finds_other_spellings(field):
    wrong = sum((field.decode([s])[0] != y).any() for s, y in map(pii.labelled_sequence, pii.EXAMPLES))
    assert wrong <= 0.05 * len(pii.EXAMPLES)
    for text, want in [
        ("the password=c0ffee1234ab was used", ("secret", "c0ffee1234ab")),
        ("from 192.0.2[.]99 again", ("ip", "192.0.2[.]99")),
        ("please call (312) 555-0101 now", ("phone", "(312) 555-0101")),
    ]:
        assert [(k, text[a:b]) for k, a, b in pii.field_spans([text], field)[0]] == [want]
    clean = ["It cost 1500 in 2010, pages 10-20.", "at 17:45 on 3.4.2020 we had 12 + 5 = 17 items (12.5 %) for 1,299.00"]
    assert pii.field_spans(clean, field) == [[], []]


def test_every_span_of_the_table_is_found_in_its_plain_sentence(field):
    for example in pii.EXAMPLES:
        text, spans = "", []
        for kind, inner, plain in re.findall(r"\{(\w+)\|([^}]*)\}|([^{]+)", example):
            if kind:
                spans.append((kind, len(text), len(text) + len(inner)))
            text += inner or plain
        assert pii.field_spans([text], field)[0] == spans
    text = "It is late.\nplease ask ann dot roe at example dot org today, or look at the house. We met at noon."
    assert [(k, text[a:b]) for k, a, b in pii.field_spans([text], field)[0]] == [("email", "ann dot roe at example dot org")]


def test_lines_that_are_passed_over_hold_no_span(field, monkeypatch):
    texts = [re.sub(r"\{\w+\|([^}]*)\}", r"\1", e) for e in pii.EXAMPLES]
    texts = ["\n".join(texts), *TEXTS, "no mark = here\n\nat\n a_at_b dot c + [x]", *map(" ".join, zip(texts, texts[1:]))]
    found = pii.field_spans(texts, field)
    monkeypatch.setattr(pii, "_NEEDED", re.compile(r"[^\n]"))
    assert found == pii.field_spans(texts, field)


def test_base_spans_stay_and_overlaps_go():
    base = [("email", 10, 20), ("phone", 30, 40)]
    more = [("secret", 15, 25), ("ip", 20, 30), ("card", 0, 10), ("phone", 30, 40), ("card", 5, 50)]
    assert pii.merged(base, more) == [("email", 10, 20), ("ip", 20, 30), ("card", 0, 10), ("phone", 30, 40)]


def test_masking():
    assert pii.masked("ab cd ef", [("email", 0, 2), ("ip", 1, 4), ("card", 6, 8)]) == "<EMAIL>d <CARD>"


def test_personal_data_query_against_the_patterns(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_personal_data"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert {pii.joined([x]) for x in base} <= set(r["spans"].split(","))


def test_personal_data_of_odd_texts(spark, field):
    kind = "doc_id long, text string, spans string, masked string, label string"
    docs = spark.createDataFrame([(i, t, "s", "m", "l") for i, t in enumerate([None, *TEXTS, "1 " * 60_000])], kind)
    rows = pii.with_personal_data(docs, field).orderBy("doc_id").collect()
    assert len(rows) == len(TEXTS) + 2 and (rows[0]["spans"], rows[0]["masked"]) == ("", "")
    assert pii.with_personal_data(docs.where("doc_id < 0"), field).collect() == []


# --- Pipeline ---------------------------------------------------------------------------------------------------------

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    """The documents of the smallest tables with planted rows, beside their labels."""
    out = str(tmp_path_factory.mktemp("tables"))
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    prose = [r["text"] for r in docs.join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where(
        "quality = 1 AND toxic = 0 AND length(text) > 600 AND lang = 'en'").orderBy("doc_id").limit(6).collect()]
    fresh = [" ".join(reversed(t.split())) for t in prose]
    rows = [(10_000 + i, fresh[0], "en", "planted", 1) for i in range(8)]
    rows += [(10_100, fresh[1] + "\nwrite to kim@mail.example.com now", "en", "src0", 1), (10_101, fresh[2], "en", None, None)]
    rows += [(10_200, None, None, None, None), (10_201, "", "en", "src1", 0), (None, fresh[3], "en", "src1", 5)]
    docs.unionByName(spark.createDataFrame(rows, DOCUMENTS)).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{base}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def test_every_stage_does_its_part(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, before, tables), "test")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    before, after = seen["quality"]
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good, bad = [i for i, q in truth.items() if q == 1], [i for i, q in truth.items() if q == 0]
    assert np.mean([i in kept for i in good]) > 0.97 and np.mean([i not in kept for i in bad]) > 0.9
    before, after = seen["line_dedup"]
    assert before.count() == after.count()
    before, after = seen["near_duplicates"]
    ids = [r["doc_id"] for r in after.collect()]
    assert sum(1 for i in ids if i is not None and 10_000 <= i < 10_008) == 1 and 10_000 in ids
    assert {10_100, 10_101, None} <= set(ids)
    before, after = seen["personal_data"]
    assert before.count() == after.count()
    text = after.where("doc_id = 10100").first()["text"]
    assert "write to <EMAIL> now" in text and "@" not in text
    before, after = seen["packing"]
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_the_run_equals_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, tables), "test")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    key = lambda df: sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    assert key(docs) == key(corpus_pipeline.run(spark, tables))


def test_stages_on_an_empty_table(spark, tables):
    docs = spark.createDataFrame([], DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, tables), "test")
        assert docs.count() == 0
