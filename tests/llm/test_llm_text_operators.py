"""Line dedup, packing, piece encoding and licence scans against plain versions of themselves."""

import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabulon.llm import licenses, line_dedup, packing, sentencepiece
from tabulon.llm.common import packed

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, size int, host string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with ones used inside."""
    full = [(i, t, None, s, None, "x", 1, "h") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, "   \n \n", "a"), (4, "one", None), (None, "two words", "b"),
    (5, "same same", "b"), (5, "same same", "b"), (6, "Ünïcode ßtrasse 日本語 ﬁ \U0001f600", "b"),
    (7, "word " * 30_000, "b"), (8, "x" * 100_000, "b"), (9, "tab\tand\x1ccontrol ▁mark  double  space ", "c"),
]


# --- Line dedup -------------------------------------------------------------------------------------------------------


def plain_line_dedup(rows, ratio, least):
    hosts = Counter(s for _, s in {(t, s) for _, t, s in rows})
    pages = Counter((s, x) for t, s in {(t, s) for _, t, s in rows} if t is not None for x in {y.strip(" ") for y in t.split("\n")} if x)
    bad = {k for k, n in pages.items() if n >= least and n > hosts[k[0]] * ratio}
    return sorted(
        (
            (i, s, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad))
            for i, t, s in rows
        ),
        key=str,
    )


def test_lines_are_dropped_by_their_share_of_pages(spark):
    rows = ODD + [(100 + i, f"menu\nown line {i}\n menu \nfoot {i % 3}", "site") for i in range(12)]
    rows += [(200 + i, "menu\nrare", "other") for i in range(4)]  # too few pages to tell
    rows += [(300 + i, "all the same", None) for i in range(6)]  # one page, stored many times
    rows += [(400 + i, f"shared\n{i // 2}", "twice") for i in range(12)]
    got = line_dedup.drop_boilerplate(docs_of(spark, rows), max_ratio=0.3)
    assert got.columns == [x.split()[0] for x in DOCS.split(", ")] + ["lines_dropped"]
    found = sorted(((r["doc_id"], r["source"], r["text"]) for r in got.collect()), key=str)
    assert found == plain_line_dedup(rows, 0.3, 5)
    assert {r["text"] for r in got.where("doc_id >= 300").collect()} == {"all the same", *"012345"}


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_boilerplate(docs_of(spark, [])).collect() == []


# --- Packing ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_tokenizer():
    return packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize(
    "text",
    [t for _, t, _ in ODD if t and len(t) < 1000]
    + ["a'S it's!'re __x_y 12ab é²½ ǅ ŉ ß", "<|endoftext|> hi", "İstanbul Σας", "a\xa0b ªº µ \xad x ɏ", "don't 'LL o'clock's"],
)
def test_units_give_the_ids_of_the_whole_text(word_tokenizer, text):
    whole = word_tokenizer.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(word_tokenizer.encode(text), "<u4").tolist() == whole


def check_packing(rows, size):
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_bin.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_bin)


def test_packing_keeps_every_token_once(spark, word_tokenizer):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(docs_of(spark, ODD), path, size=64, open_bins=4).collect()
    check_packing(rows, 64)
    want = Counter()
    for i, text, _ in ODD:
        ids = word_tokenizer.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            want[(i, k // 64, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)


def test_packing_wastes_little_with_many_buckets(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2048, 3000).tolist()
    items = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE_SCHEMA)
    rows = packing.pack(items, open_bins=64, items_per_bucket=500).collect()
    assert len(rows) == 3000
    assert check_packing(rows, 2048) <= 1.06 * math.ceil(sum(lengths) / 2048)


def test_the_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert bins.place(7) == (0, 0) and bins.place(6) == (1, 0)
    assert bins.place(5) == (2, 0)  # closes bin 0, which has three free
    assert bins.place(3) == (1, 6)  # the fullest open bin that takes it


def test_packing_of_nothing(spark):
    assert packing.pack_documents(docs_of(spark, []), public_tokenizers.path("word_bpe_49k.json")).collect() == []


# --- Piece encoding ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.PieceModel(public_tokenizers.path("piece_bpe_32k.model"))


def plain_viterbi(model, text):
    """The best score over all segmentations, position by position, without an automaton."""
    score = {p: s for p, (_, s, _) in ((p, v) for p, v in model.automaton.items())}
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + model.unknown_score
        for start in range(max(0, end - 48), end):
            if text[start:end] in score:
                best[end] = max(best[end], best[start] + score[text[start:end]])
    return best[-1]


@pytest.mark.parametrize(
    "text", ["The quick brown foxes", "unbelievably 12.5 % \n\n  spaces", "日本 ßé \U0001f600\x00", "a", " ", "\n", "aaaa bbbb" * 9]
)
def test_segmentation_has_the_best_score(pieces, text):
    ids = pieces.encode(text)
    assert pieces.decode(ids) == text
    marked = sentencepiece.MARK + text.replace(" ", sentencepiece.MARK)
    value, left = 0.0, []
    scores = {i: s for _, (_, s, i) in pieces.automaton.items()}
    for i in ids:
        if i in pieces.byte_of:
            left.append(pieces.byte_of[i])
        else:
            value += scores[i]
    value += len(bytes(left).decode()) * pieces.unknown_score
    assert value == pytest.approx(plain_viterbi(pieces, marked))


def test_segmentation_equals_the_library_on_a_unigram_model(pieces):
    """The same pieces and scores, declared as a unigram model, give the library's own Viterbi the same task."""
    from sentencepiece import SentencePieceProcessor

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    at = raw.rindex(b"\x18\x02 \x80\xfa\x01")  # trainer field 3 (kind of model) before field 4 (32,000 pieces)
    library = SentencePieceProcessor(model_proto=raw[: at + 1] + b"\x01" + raw[at + 2 :])
    for text in ["The quick brown foxes jumped over it.", "Der schnelle Fuchs", "edthe oringly. thandre\nNew line"]:
        assert pieces.encode(text) == library.encode(text)


def test_encoding_round_trip_over_a_table(spark, pieces):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentencepiece.decode_ids(sentencepiece.encode_texts(docs_of(spark, ODD), path), path).collect()
    for r in rows:
        assert (r["ids"] is None) == (r["text"] is None)
        if r["text"] is not None:
            assert r["decoded"] == r["text"].replace(sentencepiece.MARK, " ")
            assert r["ids"] == pieces.encode(r["text"])
    assert sentencepiece.encode_texts(docs_of(spark, []), path).collect() == []


# --- Licence scans ----------------------------------------------------------------------------------------------------

FILES = "path string, text string, license string, own string, word string"


def files_of(spark, rows):
    return spark.createDataFrame([(p, t, "old", "x", "y") for p, t in rows], FILES)


def test_files_inherit_from_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        ("LICENSE", f"intro\n{mit}\n" + "more words here and there " * 9), ("a/x.txt", "plain"),
        ("a/b/COPYING", apache), ("a/b/c/y.txt", "plain"), ("a/b/z.txt", f"// {mit}\ncode"), ("a/b/c/", None),
        ("other.txt", ""), (None, mit), ("a/b/c/y.txt", "plain"), ("ab/q", "all rights are not reserved here, see below"),
    ]
    got = {}
    for r in licenses.scan(files_of(spark, rows)).collect():
        got.setdefault(r["path"], set()).add((r["license"], r["origin"], r["source_path"], r["line_no"]))
    assert got == {
        "LICENSE": {("MIT", "header", None, 2)},
        "a/x.txt": {("MIT", "inherited", "LICENSE", None)},
        "a/b/COPYING": {("Apache-2.0", "header", None, 1)},
        "a/b/c/y.txt": {("Apache-2.0", "inherited", "a/b/COPYING", None)},
        "a/b/z.txt": {("MIT", "header", None, 1)},
        "a/b/c/": {("Apache-2.0", "inherited", "a/b/COPYING", None)},
        "other.txt": {("MIT", "inherited", "LICENSE", None)},
        None: {(None, "none", None, None)},
        "ab/q": {("MIT", "inherited", "LICENSE", None)},
    }


def plain_notices(files, window=licenses.WINDOW):
    """(path, line_no, lines): greatest cosine of every unit of every file to its templates, without any test."""
    texts = [t for _, t in (*licenses.TEMPLATES, *licenses.LICENSE_TEXTS)]
    bag = lambda x: Counter(re.findall("[a-z0-9]+", x.lower()))
    templates = [bag(x) for x in texts]
    held = [bag(x) for _, x in files]
    idf = {w: math.log((1 + len(files)) / (1 + sum(w in c for c in held))) + 1 for c in templates for w in c}
    other = sum(idf.values()) / len(idf)
    out = {}
    for path, text in files:
        lines = text.split("\n")
        named = re.search(r"(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$", path, re.I)
        spans = [(i, n) for i in range(len(lines)) for n in range(1, window + 1) if i + n <= len(lines)]
        spans = [(i, n) for i, n in spans if bag(lines[i]) and bag(lines[i + n - 1])]
        if named and len(lines) > window:
            spans.append((0, len(lines)))
        for i, n in spans:
            unit = bag("\n".join(lines[i : i + n]))
            own = math.sqrt(sum((k * idf.get(w, other)) ** 2 for w, k in unit.items()))
            for template in templates if named else templates[: len(licenses.TEMPLATES)]:
                norm = math.sqrt(sum((k * idf[w]) ** 2 for w, k in template.items()))
                cosine = sum(k * template[w] * idf[w] ** 2 for w, k in unit.items()) / own / norm
                if cosine >= 0.7:
                    out[path, i + 1, n] = max(out.get((path, i + 1, n), 0), round(cosine, 9))
    return out


def test_the_word_test_loses_no_notice(spark):
    lines = ["under the MIT License", "released under license", "version 2.0 of the license", "all rights", "reserved rights",
             "by nc 4 0", "licensed", "the the the", "apache", "", "Licensed under CC BY 4.0!", "redistribution and use in",
             "source and binary forms", "-- --", "granted, free of charge, to any person", "permission is hereby"]
    rng = random.Random(4)
    files = [(f"d/{i}", x) for i, x in enumerate(lines)]
    files += [(f"{i}/{n}", "\n".join(rng.choices(lines, k=rng.randint(2, 14)))) for i in range(30) for n in ("x", "LICENSE")]
    got = {(r["path"], r["line_no"], r["lines"]): round(r["cosine"], 9) for r in licenses.notices(files_of(spark, files)).collect()}
    want = plain_notices(files)
    assert got == want and len(want) >= 30 and max(n for _, _, n in want) > 2


def wrapped(text, prefix="", width=60):
    return "\n".join(prefix + x for x in textwrap.wrap(text, width))


def test_headers_over_lines_and_licence_files(spark):
    """Headers wrapped in comments, titles and whole texts are found, and what lies below them inherits."""
    texts = dict(reversed(licenses.LICENSE_TEXTS))  # the first of each licence
    whole = {name: text for name, text in licenses.LICENSE_TEXTS}  # the last of each licence
    headers = {name: text for name, text in licenses.TEMPLATES}
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n"
    rows = [
        ("p/LICENSE", gpl + " Everyone is permitted to copy and distribute verbatim copies\n" + "of this document. " * 40),
        ("p/src/a.c", "int main() {}"),
        ("q/COPYING", "MIT License\n\nCopyright (c) 2021 Foo"),
        ("q/b.py", "import os"),
        ("r/licence.txt", "Copyright (c) 2020 Bar\n\n" + wrapped(whole["MIT"])),
        ("s/LICENSE.md", "Copyright (c) 2020, Bar\nAll rights reserved.\n\n" + wrapped(whole["BSD-3-Clause"])),
        ("t/LICENSE", "Copyright (c) 2020, Bar\n\n" + wrapped(whole["BSD-2-Clause"])),
        ("u/LICENSE", "not a known one at all\n" * 30),
        ("u/c.py", "MIT License"),  # a title counts in licence files only
        ("v/d.py", "#!/usr/bin/python\n" + wrapped(headers["LGPL-3.0"], "# ") + "\nimport os\n" + "x = 1\n" * 40),
        ("v/e.js", "/*\n" + wrapped(headers["MPL-2.0"], " * ") + "\n */\n" + "let x = 1\n" * 40),
        ("v/f.go", "// one\n\n" + wrapped(headers["Apache-2.0"], "// ", 76) + "\npackage x\n" + "func y()\n" * 40),
        ("w/NOTICE", "Copyright (c) 2021 Example Corporation. All rights reserved."),
        ("x/LICENSE", wrapped(texts["Apache-2.0"], "   ", 30)),
    ]
    rows += [(f"z/{i}", f"the other files of any kind are {i}") for i in range(20)]
    got = {r["path"]: r for r in licenses.scan(files_of(spark, rows)).collect()}
    want = {
        "p/LICENSE": "GPL-3.0", "p/src/a.c": "GPL-3.0", "q/COPYING": "MIT", "q/b.py": "MIT", "r/licence.txt": "MIT",
        "s/LICENSE.md": "BSD-3-Clause", "t/LICENSE": "BSD-2-Clause", "u/LICENSE": None, "u/c.py": None, "v/d.py": "LGPL-3.0",
        "v/e.js": "MPL-2.0", "v/f.go": "Apache-2.0", "w/NOTICE": "Proprietary", "x/LICENSE": "Apache-2.0",
    }
    assert {p: got[p]["license"] for p in want} == want
    assert (got["p/LICENSE"]["line_no"], got["p/LICENSE"]["lines"]) == (1, 2)
    assert got["q/b.py"]["source_path"] == "q/COPYING" and got["v/d.py"]["lines"] > 3
    assert all(got[f"z/{i}"]["license"] is None for i in range(20))


def test_license_scan_keeps_columns_called_like_its_own(spark):
    names = "_path string, _own string, _dir string, _near string, _from string, lines int, path string, text string"
    rows = licenses.scan(spark.createDataFrame([("a", "b", "c", "d", "e", 9, "x/LICENSE", "MIT License")], names)).collect()
    assert [tuple(r)[:5] for r in rows] == [("a", "b", "c", "d", "e")] and (rows[0]["license"], rows[0]["lines"]) == ("MIT", 1)


def test_license_scan_of_nothing_and_long_lines(spark):
    assert licenses.scan(files_of(spark, [])).collect() == []
    rows = licenses.scan(files_of(spark, [("a", "license " * 50_000), ("b", "x" * 200_000)])).collect()
    assert {r["origin"] for r in rows} == {"none"}


def test_line_dedup_keeps_columns_called_like_its_own(spark):
    rows = [(i, f"same line\nown {i}", "h", 1, 2, 3) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _drop int, _host int, _kept int")
    found = line_dedup.drop_boilerplate(docs).collect()
    assert {(r["text"], r["_drop"], r["_host"], r["_kept"]) for r in found} == {(f"own {i}", 1, 2, 3) for i in range(10)}


@pytest.mark.parametrize("name, words", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_of_any_vocabulary_equal_whole_texts(name, words):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    coded = packing.WordTokenizer(path)
    assert coded.by_words == words
    for text in ("Hello  World, it's 2024!", " two\n\nlines\t", "Ünïcode 字 x", ""):
        assert coded.encode(text) == packed(whole.encode(text, add_special_tokens=False).ids)
