"""One query per corpus operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tabulon.llm import (
    ann, collocations, decontamination, embedding_dedup, licenses, line_dedup, ngram_join, packing, periodic_runs, pii,
    quality, sentencepiece, toxicity,
)
from tabulon.llm.common import id_remainder, labelled, stored
from tabulon.operators.lookup import fits_broadcast
from tabulon.plans.catalog import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@query("op1_sentencepiece")
def op1(spark, sf):
    """Ids of every text, and whether they decode to it."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = sentencepiece.encode_and_decode(docs, path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


@query("op3_best_fit_packing")
def op3(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def train_rows(docs, labels, name, modulus, held):
    """Labelled rows that are not held out; the labels are broadcast only when their measured size allows it."""
    labels = stored(labels.where(id_remainder("doc_id", modulus) != held).select("doc_id", name), "labels")
    labels = F.broadcast(labels) if fits_broadcast(labels) else labels
    return labelled(docs, labels, name)


@query("op6_quality")
def op6(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    measured = stored(quality.with_statistics(docs).drop("text"), "statistics")
    model = quality.fit(train_rows(measured, table(spark, sf, "labels"), "quality", 3, 1))
    scored = quality.with_scores(measured, model, column="statistics")
    return scored.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query("op7_toxicity")
def op7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = train_rows(docs, table(spark, sf, "labels"), "toxic", 5, 0)
    fold = id_remainder("doc_id", 5)
    model = toxicity.count_models(rows.where(fold != 4))
    model = toxicity.calibrate(model, rows.where(fold == 4))
    return toxicity.with_scores(docs, model).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted"
    )


LINES_SQL = r"""
WITH lines AS (
    SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS at
    FROM documents),
totals AS (
    SELECT source, count(DISTINCT text) + max((text IS NULL)::INTEGER) AS host_pages FROM documents GROUP BY source),
counts AS (
    SELECT source, trim(line, ' ') AS line, count(DISTINCT text) AS pages
    FROM lines WHERE trim(line, ' ') <> '' GROUP BY ALL),
boilerplate AS (
    SELECT source, line FROM counts JOIN totals USING (source) WHERE pages >= 5 AND pages > host_pages * 0.1),
kept AS (
    SELECT l.doc_id, l.source, count(b.line) AS lines_dropped,
        coalesce(string_agg(l.line, chr(10) ORDER BY l.at) FILTER (WHERE b.line IS NULL), '') AS text
    FROM lines l LEFT JOIN boilerplate b ON l.source = b.source AND trim(l.line, ' ') = b.line
    GROUP BY l.doc_id, l.source)
SELECT doc_id, source, lines_dropped, text FROM kept
UNION ALL SELECT doc_id, source, 0, text FROM documents WHERE text IS NULL
"""


@query("op10_line_dedup", LINES_SQL)
def op10(spark, sf):
    return line_dedup.drop_boilerplate(table(spark, sf, "documents")).select(
        "doc_id", "source", "lines_dropped", "text"
    )


NEAR_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, string_split_regex(trim(text, E' \n\t\r'), '[ \n\t\r]+') AS w FROM documents
    WHERE trim(coalesce(text, ''), E' \n\t\r') <> ''),
grams AS (
    SELECT DISTINCT doc_id, unnest(list_transform(
        range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY ALL),
links AS (
    SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 10 * common >= 8 * (s.n + t.n - common)),
reach AS (SELECT a AS id, a AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY 1)
SELECT d.doc_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, d.doc_id) AS component_id,
    coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN least l ON l.id = d.doc_id LEFT JOIN counts c ON c.id = d.doc_id
"""


@query("op5_ngram_jaccard_join", NEAR_SQL)
def op5(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents")).drop("text_key")


VECTOR_SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT a AS id, a AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
    coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN least l ON l.id = e.vec_id LEFT JOIN counts c ON c.id = e.vec_id
"""


@query("op4_embedding_near_dedup", VECTOR_SQL)
def op4(spark, sf):
    return embedding_dedup.near_duplicates(table(spark, sf, "embeddings"))


@query("op9_nearest_neighbours")
def op9(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query("op8_personal_data")
def op8(spark, sf):
    found = pii.with_personal_data(table(spark, sf, "documents").select("doc_id", "text"))
    return found.withColumns(pii.span_counts("base_spans")).drop("text", "masked", "base_spans")


#: Where a document would lie in a tree: by source and language, and by its id at one of three depths; every fifth is
#: named like a licence.
PLACE = """concat_ws('/', source, CASE WHEN doc_id % 4 > 0 THEN lang END,
    CASE WHEN doc_id % 4 > 1 THEN concat('part', doc_id % 7) END,
    concat(doc_id, CASE WHEN doc_id % 5 = 0 THEN '/COPYING' ELSE '.txt' END))"""
LICENSE_SQL = f"""
WITH files AS (
    SELECT doc_id, {PLACE} AS path, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts,
        doc_id % 5 = 0 AS named FROM documents),
templates(template, license, file_only, notice) AS (VALUES {', '.join(
    f"({i}, '{name}', {i >= len(licenses.TEMPLATES)}, '{text}')"
    for i, (name, text) in enumerate((*licenses.TEMPLATES, *licenses.LICENSE_TEXTS)))}),
tw AS (SELECT template, license, file_only, word, count(*) AS n FROM (
    SELECT * EXCLUDE notice, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS word FROM templates) GROUP BY ALL),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM files) GROUP BY word),
idf AS (
    SELECT word, ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(df, 0))) + 1 AS idf
    FROM (SELECT DISTINCT word FROM tw) LEFT JOIN df USING (word)),
weights AS (
    SELECT template, license, file_only, word, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY template)) AS share
    FROM tw JOIN idf USING (word)),
units AS (
    SELECT path, named, line_no, lines, array_to_string(parts[line_no:line_no + lines - 1], chr(10)) AS unit
    FROM files, unnest(range(1, len(parts) + 1)) AS a(line_no), unnest(range(1, {licenses.WINDOW + 1})) AS b(lines)
    WHERE line_no + lines - 1 <= len(parts) AND regexp_matches(lower(parts[line_no]), '[a-z0-9]')
        AND regexp_matches(lower(parts[line_no + lines - 1]), '[a-z0-9]')
    UNION ALL SELECT path, named, 1, len(parts), text FROM files WHERE named AND len(parts) > {licenses.WINDOW}),
uw AS (SELECT path, named, line_no, lines, word, count(*) AS n FROM (
    SELECT * EXCLUDE unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) AS word FROM units) GROUP BY ALL),
sizes AS (
    SELECT path, line_no, lines, sqrt(sum((n * coalesce(idf, (SELECT avg(idf) FROM idf))) ** 2)) AS norm,
        sum(n) AS unit_words
    FROM uw LEFT JOIN idf USING (word) GROUP BY ALL),
near AS (
    SELECT path, line_no, lines, template, license, unit_words, round(sum(n * idf * share) / any_value(norm), 12) AS cosine
    FROM uw JOIN weights USING (word) JOIN idf USING (word) JOIN sizes USING (path, line_no, lines)
    WHERE named OR NOT file_only GROUP BY ALL),
own AS (
    SELECT * FROM near WHERE cosine >= 0.7
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY license = '{licenses.RESERVED}', cosine DESC, line_no, lines, template) = 1),
holders AS (
    SELECT path, license, cosine, regexp_replace(path, '/[^/]*$', '') AS above FROM own JOIN files USING (path)
    WHERE named OR unit_words >= 0.2 * len(regexp_extract_all(lower(text), '[a-z0-9]+'))),
held AS (
    SELECT above, license, path AS source_path FROM holders
    QUALIFY row_number() OVER (PARTITION BY above ORDER BY license = '{licenses.RESERVED}', cosine DESC, path) = 1),
nearest AS (
    SELECT f.path, h.license, h.source_path FROM files f JOIN held h ON starts_with(f.path, concat(h.above, '/'))
    QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY len(h.above) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(o.license, n.license) AS license,
    CASE WHEN o.path IS NOT NULL THEN 'header' WHEN n.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
    round(o.cosine, 6) AS cosine, o.line_no::INTEGER AS line_no, o.lines::INTEGER AS lines,
    CASE WHEN o.path IS NULL THEN n.source_path END AS source_path
FROM files f LEFT JOIN own o USING (path) LEFT JOIN nearest n USING (path)
"""


@query("op2_license_scan", LICENSE_SQL)
def op2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.expr(PLACE).alias("path"))
    found = licenses.scan(docs, file_share=0.2)
    return found.select(
        "doc_id", "path", "license", "origin", F.round("cosine", 6).alias("cosine"), "line_no", "lines", "source_path"
    )


#: The words of a text, its rank among the documents that get a repetition, and what that repeats.
WORDS = "filter(split(coalesce(text, ''), '[ \\\\t-\\\\r]+'), w -> w <> '')"
REPEATED = """CASE WHEN h % 10 = 0 AND n > 0 THEN array_join(concat(slice(words, 1, a),
    slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) AS int))), 1, n - a)), ' ') ELSE text END"""


def with_repetition(docs):
    """`doc_id, text`: every tenth document, by the checksum of its id, repeats a part of its words to its end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(WORDS))).withColumn("n", F.size("words"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("cast(g % nullif(n, 0) AS int)"))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) AS int)"))
    return rows.select("doc_id", F.expr(REPEATED).alias("text"))


@query("op13_periodic_runs")
def op13(spark, sf):
    found = periodic_runs.with_runs(with_repetition(table(spark, sf, "documents")))
    found = found.withColumn("best", F.expr(periodic_runs.LONGEST))
    line = "concat(r.start, ',', r.length, ',', r.period, '\\n')"
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(f"array_join(transform(runs, r -> {line}), '')").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


SHARED_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
    SELECT item, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
        lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (
    SELECT r, size, unnest(range(1, len(w) - size + 2)) AS k FROM d JOIN sizes ON len(w) >= size),
hits AS (
    SELECT DISTINCT dw.r, dw.size, k, item FROM dw JOIN d USING (r)
    JOIN iw ON iw.size = dw.size AND iw.g = array_to_string(w[k:k + dw.size - 1], ' ')),
covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS place FROM hits) GROUP BY r),
owners AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN owners USING (r)
"""


@query("op11_decontamination", SHARED_SQL)
def op11(spark, sf):
    found = decontamination.contamination(
        table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


PHRASE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM words),
spelled AS (SELECT lang, w[k] AS x, w[k + 1] AS y, w[k + 2] AS z FROM places),
f1 AS (SELECT lang, x, count(*) AS f FROM spelled GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS f FROM spelled WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM spelled WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
    SELECT p.lang, p.x || ' ' || p.y AS phrase, p.f AS a, 1 AS k, u.f AS l, v.f AS r
    FROM f2 p JOIN f1 u ON u.lang = p.lang AND u.x = p.x JOIN f1 v ON v.lang = p.lang AND v.x = p.y
    UNION ALL
    SELECT p.lang, p.x || ' ' || p.y || ' ' || p.z, p.f, 1, u.f, v.f
    FROM f3 p JOIN f1 u ON u.lang = p.lang AND u.x = p.x JOIN f2 v ON v.lang = p.lang AND v.x = p.y AND v.y = p.z
    UNION ALL
    SELECT p.lang, p.x || ' ' || p.y || ' ' || p.z, p.f, 2, u.f, v.f
    FROM f3 p JOIN f2 u ON u.lang = p.lang AND u.x = p.x AND u.y = p.y JOIN f1 v ON v.lang = p.lang AND v.x = p.z),
scored AS (
    SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts
    QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, phrase, max(f) AS longer FROM (
        SELECT lang, x || ' ' || y AS phrase, f FROM f3 UNION ALL SELECT lang, y || ' ' || z, f FROM f3) GROUP BY ALL),
kept AS (
    SELECT s.lang, s.phrase, a, l, r, score
    FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
    WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


@query("op12_collocations", PHRASE_SQL)
def op12(spark, sf):
    return collocations.collocations(table(spark, sf, "documents").select("text", "lang"))
