"""Near duplicates of texts and vectors, components and nearest neighbours against brute force."""

import inspect
import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import ann, embedding_dedup, ngram_join
from tabulon.llm.common import labelled
from tabulon.llm.components import components
from tabulon.llm.queries import QUERIES


def groups_of(nodes, links):
    """The smallest node each node is connected with."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (3, 900), (900, 901), (None, 4), (50, 3), (1, 2), (2, 1)]
    edges += [(1000, 1000 + i) for i in range(1, 300)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert {r["id"]: r["component"] for r in got.collect()} == groups_of({x for e in real for x in e}, real)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- Texts ------------------------------------------------------------------------------------------------------------


def gram_set(text, n=5):
    w = text.split() if text else []
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def text_rows():
    rng = np.random.default_rng(1)
    word = lambda: "w%d" % rng.integers(0, 3000)
    rows, key = [], 0
    base = [word() for _ in range(150)]
    for _ in range(320):  # more than a chunk of near copies of one text, at all distances
        text = list(base)
        for p in rng.choice(150, rng.integers(0, 8), replace=False):
            text[p] = word()
        rows.append((key, " ".join(text)))
        key += 1
    for _ in range(60):
        text = [word() for _ in range(rng.integers(1, 60))]
        rows.append((key, " ".join(text)))
        changed = list(text)
        changed[rng.integers(0, len(text))] = word()
        rows.append((key + 1, "  ".join(changed)))
        key += 2
    rows += [(key + i, "copy of the very same text here") for i in range(40)]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "a"), (5004, "a"), (5005, "a b"), (5006, "z " * 9000)]
    return rows


def schema_rows(spark, rows):
    kind = "doc_id long, text string, class string, band int, n_links string, kept string"
    return spark.createDataFrame([(i, t, "c", 1, "x", None) for i, t in rows], kind)


def test_near_duplicate_texts_equal_brute_force(spark):
    rows = text_rows()
    sets = {i: gram_set(t) for i, t in rows}
    links = Counter()
    pairs = []
    for (i, a), (j, b) in combinations(sets.items(), 2):
        both = len(a & b)
        if both and 10 * both >= 8 * (len(a) + len(b) - both):
            links[i] += 1
            links[j] += 1
            pairs.append((i, j))
    root = groups_of(sets, pairs)
    got = ngram_join.near_duplicates(schema_rows(spark, rows)).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r for r in got}
    assert sum(r["n_links"] for r in got) >= 0.999 * sum(links.values())
    assert all(found[i]["n_links"] <= links[i] for i in sets)
    wrong = [i for i in sets if found[i]["component_id"] != root[i]]
    assert wrong == []
    assert {i for i in sets if found[i]["kept"]} == set(root.values())


def test_repeated_rows_and_null_ids(spark):
    text = "some words that are here more than once in all"
    rows = [(4, text), (4, text), (9, text), (None, text), (7, "quite another text of a few words"), (7, None), (None, None)]
    docs = schema_rows(spark, rows)
    got = Counter((r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in ngram_join.near_duplicates(docs).collect())
    assert got == Counter(
        [(4, 3, 4, True)] * 2 + [(9, 3, 4, False), (None, 3, 4, False), (7, 0, 7, True), (7, 0, 7, True), (None, 0, None, True)]
    )
    left = ngram_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(
        [(4, text), (7, "quite another text of a few words"), (7, None), (None, None)]
    )


def test_no_texts(spark):
    assert ngram_join.near_duplicates(schema_rows(spark, [])).collect() == []
    assert ngram_join.drop_near_duplicates(schema_rows(spark, [])).collect() == []


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


# --- Vectors ----------------------------------------------------------------------------------------------------------

VECTOR = "vec_id long, embedding array<float>, label int, row string, unit int, band string, id string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", 2, "b", "i") for i, v in rows], VECTOR)


def vector_rows(width=24):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [rng.standard_normal(width) for _ in range(250)]
    centre = unit(rng.standard_normal(width))
    rows += [unit(centre + unit(rng.standard_normal(width)) * rng.uniform(0, 0.6)) * rng.uniform(0.1, 9) for _ in range(250)]
    rows += [rows[3], rows[3] * 2, -rows[3]]
    rows = [(10 * i + 7, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * width, [float("nan")] * width, [1.0] * (width - 1) + [float("inf")], [None] + [1.0] * (width - 1), [1.0, 2.0]]
    return rows, rows + [(100_000 + i, v) for i, v in enumerate(odd)]


def test_near_duplicate_vectors_against_brute_force(spark):
    good, rows = vector_rows()
    x = np.array([v for _, v in good])
    ids = [i for i, _ in good]
    cosine = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    linked = cosine >= 0.9
    np.fill_diagonal(linked, False)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(vectors_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    want = dict(zip(ids, linked.sum(axis=1).tolist()))
    assert all(got[i]["n_links"] <= want[i] for i in ids)  # none below the threshold
    assert sum(got[i]["n_links"] for i in ids) >= 0.99 * sum(want.values())
    root = groups_of(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked)) if a < b])
    wrong = [i for i in ids if got[i]["component_id"] != root[i]]
    assert len(wrong) <= 3
    for i, _ in rows[len(good) :]:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)


def test_links_near_the_threshold_are_mostly_found(spark):
    """Pairs just above the threshold, where the bands find the fewest."""
    rng = np.random.default_rng(9)
    rows, width = [], 48
    for i in range(200):
        a = rng.standard_normal(width)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(width)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.902 * a + math.sqrt(1 - 0.902**2) * b).tolist())]
    got = embedding_dedup.near_duplicates(vectors_of(spark, rows)).where("n_links > 0").count()
    assert got >= 0.97 * 400


def test_repeated_vectors_and_none(spark):
    got = embedding_dedup.near_duplicates(vectors_of(spark, [(3, [1.0, 2.0]), (3, [1.0, 2.0]), (1, [2.0, 4.0]), (None, [1.0, 2.0])]))
    assert Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()) == Counter(
        [(3, 3, 1, False)] * 2 + [(1, 3, 1, True), (None, 3, 1, True)]
    )
    assert embedding_dedup.near_duplicates(vectors_of(spark, [])).collect() == []
    assert embedding_dedup.near_duplicates(vectors_of(spark, [(1, None)])).collect()[0]["component_id"] == 1


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    width = 64
    x = rng.standard_normal((4000, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = 0.7 * x + 0.3 * np.roll(x, 1, axis=0)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    rotation = embedding_dedup.rotations(width, 1)[0]
    codes, factors = embedding_dedup.encode(x, rotation)
    found, spread = embedding_dedup.estimate(codes, factors, y, rotation)
    error = found - np.einsum("ij,ij->i", x, y)
    assert abs(error.mean()) < 0.005
    assert (np.abs(error) <= embedding_dedup.CONFIDENCE * spread).mean() > 0.9995


# --- Nearest neighbours -----------------------------------------------------------------------------------------------


def brute_neighbours(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = [(-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in rows if i != q]
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def test_neighbours_reach_the_recall(spark):
    good, rows = vector_rows()
    queries = [r for r in rows if r[0] % 2 == 1][::5] + rows[-7:]
    got = ann.nearest(vectors_of(spark, rows), vectors_of(spark, queries), k=10, rows_per_block=200)
    found = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    vectors = dict(good)
    asked = [q for q in queries if q[0] in vectors]
    want = brute_neighbours(good, asked, 10)
    assert set(found) == set(want)
    hits = sum(len({i for i, _ in found[q]} & set(want[q])) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        for i, score in near:
            assert score == pytest.approx(float(np.dot(vectors[q], vectors[i])), rel=1e-12, abs=1e-12)


def test_fewer_candidates_than_asked(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0]), (None, [1.0, 1.0])]
    got = ann.nearest(vectors_of(spark, rows), vectors_of(spark, rows[:1]))
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == [
        (1, 2, 0.5), (2, 3, 0.5), (3, 4, -1.0), (4, 4, -1.0)
    ]
    assert ann.nearest(vectors_of(spark, []), vectors_of(spark, [])).collect() == []
    assert ann.nearest(vectors_of(spark, rows), vectors_of(spark, [])).collect() == []


def test_the_registered_search_has_a_recall_of_nine_tenths(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = defaultdict(set)
    for r in QUERIES["op9_nearest_neighbours"](spark, sf).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_windows_leave_out_most_vectors(spark):
    """With the default parameters at most four tenths of the vectors collide often enough to be scored."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, matrix = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    default = {name: p.default for name, p in inspect.signature(ann.nearest).parameters.items()}
    index = ann.CollisionIndex(ids, matrix, float(np.linalg.norm(matrix, axis=1).max()), default["projections"])
    asked = np.flatnonzero(ids % 20 == 0)
    for at in asked:
        index.search(int(ids[at]), matrix[at], 20, default["share"], default["recall"])
    assert index.verified <= 0.4 * len(ids) * len(asked)


@pytest.mark.parametrize("sets", [1, 2, 3, 5, 64, 160])
def test_memberships_are_counted_in_bits(sets):
    member = np.random.default_rng(sets).random((sets, 3, 128)) < 0.8
    words = np.packbits(member, axis=-1, bitorder="little").view("<u8")
    sums, want = ann.bit_sums(words), member.sum(axis=0)
    unpack = lambda x: np.unpackbits(x.view(np.uint8), axis=-1, bitorder="little")
    assert len(sums) == sets.bit_length() and (sum(unpack(x).astype(int) << i for i, x in enumerate(sums)) == want).all()
    for least in range(1, sets + 1):
        assert (unpack(ann.at_least(sums, least)) == (want >= least)).all()


@pytest.mark.parametrize("rows, exact", [(1, True), (130, True), (2000, True), (9000, False)])
def test_words_of_windows_hold_what_plain_counting_finds(rows, exact):
    """Rows in enough windows are found 64 at a time: with a mark for each row they and no others, else few more."""
    rng = np.random.default_rng(rows)
    vectors = rng.standard_normal((rows, 12))
    vectors[rows // 2 :: 7] = vectors[0]
    longest = float(np.linalg.norm(vectors, axis=1).max())
    index = ann.CollisionIndex(np.arange(rows), vectors, longest, 40)
    rest = np.sqrt(np.maximum(longest**2 - np.square(vectors).sum(axis=1), 0))
    placed = index.directions @ np.c_[vectors, rest].T
    places, widths = index.directions[:, :-1] @ vectors[:5].T, np.array([0.5, 2.0, 4.0, 8.0, math.inf])[: min(rows, 5)]
    got = np.unpackbits(index.reached(places, widths, 34).view(np.uint8), axis=1, bitorder="little")
    for words, place, width in zip(got, places.T, widths):
        want = (np.abs(placed - place[:, None]) < width).sum(axis=0) >= 34
        assert not words[rows:].any() and words[:rows][want].all()
        assert words.sum() <= want.sum() + (0 if exact else 0.02 * rows)
    assert index.before.shape[2] == math.ceil(rows / 64)


def test_marks_take_no_more_than_sixteen_bytes_for_a_projected_row():
    vectors = np.random.default_rng(2).standard_normal((65_536, 4))
    index = ann.CollisionIndex(np.arange(65_536), vectors, 9.0, 6)
    assert index.before.nbytes <= 16.2 * 6 * 65_536
    asked = list(range(0, 65_536, 9000))
    together = index.search_all(asked, vectors[asked], 5, 0.85, 0.97)
    assert together == [index.search(i, vectors[i], 5, 0.85, 0.97) for i in asked]


def test_a_search_of_too_long_vectors_ends():
    vectors = np.array([[1e200, 0.0], [0.0, 1e200], [1.0, 1.0]])
    with np.errstate(all="ignore"):
        found = ann.CollisionIndex(np.arange(3), vectors, math.inf, 20).search(0, vectors[0], 5, 0.85, 0.97)
    assert sorted(i for i, _ in found) == [1, 2]


def test_blocks_are_bounded_and_few():
    assert [ann.block_count(n, 65_536) for n in (0, 1, 8192, 8193, 51_282, 262_144, 10**7)] == [1, 1, 1, 2, 4, 4, 153]


def test_many_blocks_give_what_one_gives(spark):
    """Wide enough windows find every neighbour, in one block or in many."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(6).round(1).tolist()) for i in range(400)] + [(7, [1.0] * 6)]
    asked = vectors_of(spark, rows[::9])
    every = [ann.nearest(vectors_of(spark, rows), asked, k=5, recall=1 - 1e-9, rows_per_block=n) for n in (50, 1000)]
    few, one = [sorted(tuple(r) for r in found.collect()) for found in every]
    assert few == one and len(one) == 5 * len(rows[::9])


def test_the_default_search_loses_few_neighbours(spark):
    path = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = defaultdict(set)
    for r in QUERIES["op9_nearest_neighbours"](spark, path).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        scores = matrix @ matrix[at]
        scores[at] = -np.inf
        want = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        hits, total = hits + len(got[int(ids[at])] & want), total + len(want)
    print("recall", hits / total)
    assert hits >= 0.98 * total


def test_near_duplicates_keep_columns_called_like_their_own(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 1, 2, 3), (2, text, 1, 2, 3), (2, text, 1, 2, 3), (3, "other words", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _near_id int, _near_key int, _near_text int")
    assert sorted(tuple(r) for r in ngram_join.drop_near_duplicates(docs).collect()) == [rows[0], rows[3]]


def test_labels_join_beside_a_column_called_like_theirs(spark):
    docs = spark.createDataFrame([(1, 7), (2, 8)], "doc_id long, _labelled_id int")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in labelled(docs, labels, "quality").collect()] == [(1, 7, 1)]


@pytest.mark.parametrize("width", [3, 64, 100])
def test_differing_bits_rule_out_strays_and_no_link(spark, width):
    rng = np.random.default_rng(width)
    a = rng.standard_normal((3000, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = a + rng.standard_normal(a.shape) * 0.45 / math.sqrt(width)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = np.einsum("ij,ij->i", a, b)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((a, b)))]
    table = spark.createDataFrame(rows, "row long, embedding array<double>")
    bits = F.struct(*embedding_dedup._parts(width))
    coded = embedding_dedup._prepared(table, width, embedding_dedup.rotations(width, 1)[0]).select("row", bits.alias("x"))
    other = coded.select((F.col("row") - 3000).alias("row"), F.col("x").alias("y"))
    passed = embedding_dedup.may_reach(width, "x", "y", F.lit(0.9))
    linked = {r[0] for r in coded.join(other, "row").where(passed).select("row").collect()}
    assert set(np.flatnonzero(cosine >= 0.9)) <= linked
    strays = coded.where("row < 3000").join(other.select((F.col("row") + 1).alias("row"), "y"), "row").where(passed).count()
    assert width < 64 or strays < 150
