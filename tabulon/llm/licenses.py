"""License scans: headers and licence files by sparse TF-IDF cosine to templates, then inheritance along directories.

DataFrame functions only. What is compared are headers, windows of 1 to `window` consecutive lines that
start and end with a line that has words, and the whole texts of files named like licences. A unit is a
notice of the template it is most similar to, if the cosine is `threshold` or more. `TEMPLATES` are for
all files; the titles and texts of `LICENSE_TEXTS` only for files named like licences. Words are runs of
a-z and 0-9 of the lower-case text; a word of the templates weighs ln((1 + files) / (1 + files with
it)) + 1, any other word their mean.

Most windows are ruled out by a word test that cannot lose a notice: for every template the commonest
words are left out as long as they could not reach the threshold by themselves, and a unit without
any of the remaining words is no notice.

A licence file has a notice, and is named like a licence or consists of its most similar notice to a
share of `file_share` of its words; it holds for its directory. A file without a notice of its own
inherits from the nearest directory above it. Directories are resolved once each, before files are
joined to them, so a directory with a third of all files is a single row in the search for ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.common import free_name, stored
from tabulon.operators.lookup import fits_broadcast


def _gnu_header(license: str, version: str) -> str:
    """The paragraph that the GNU licences ask to have at the top of files."""
    return (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        f"{license} as published by the Free Software Foundation, either version {version} of the License, or (at your "
        "option) any later version."
    )


# The wording of common licences, as published.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
BSD_REST = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
ISC_REST = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
#: Headers and short notices of any file, one or more for each licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright (c). All rights reserved."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", MIT_GRANT),
    ("GPL-2.0", _gnu_header("General Public License", "2")),
    ("GPL-3.0", _gnu_header("General Public License", "3")),
    ("LGPL-2.1", _gnu_header("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _gnu_header("Lesser General Public License", "3")),
    ("AGPL-3.0", _gnu_header("Affero General Public License", "3")),
    ("BSD-3-Clause", BSD_GRANT),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("ISC", ISC_GRANT),
)
#: Titles and whole texts, for files named like licences.
LICENSE_TEXTS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("MIT", f"{MIT_GRANT} {MIT_REST}"),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_TWO} {BSD_REST}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_TWO} {BSD_THIRD} {BSD_REST}"),
    ("ISC", f"{ISC_GRANT} {ISC_REST}"),
)
LICENSE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
WORD = "[a-z0-9]+"
#: What a reservation of rights is called. It stands in many licence files, so any licence found beside it counts first.
RESERVED = "Proprietary"
#: Lines of the longest header that is compared.
WINDOW = 8


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def template_words(templates=TEMPLATES) -> list[Counter]:
    return [Counter(re.findall(WORD, text.lower())) for _, text in templates]


def document_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files and, for each word of the templates, of files with it; only these words reach the driver."""
    wanted = F.array(*[F.lit(w) for w in vocabulary])
    found = files.select(F.explode(F.array_intersect(words("text"), wanted)).alias("word")).groupBy("word").count()
    return files.count(), {r["word"]: r["count"] for r in found.collect()}


def anchors(weights: list[dict[str, float]], idf: dict[str, float], threshold: float) -> list[str]:
    """Words of which every unit similar to a template has at least one: the commonest are left out while that is safe."""
    out: set[str] = set()
    for weight in weights:
        total = sum(w * w for w in weight.values())
        rest = 0.0
        for word, w in sorted(weight.items(), key=lambda x: (idf[x[0]], x[0])):
            if rest + w * w < (threshold * threshold - 1e-9) * total:
                rest += w * w
            else:
                out.add(word)
    return sorted(out)


def _any_of(vocabulary: list[str]) -> str:
    """A pattern for lower-case texts that have one of these words, which are tried by their first letter."""
    rests: dict[str, list[str]] = {}
    for word in vocabulary:
        rests.setdefault(word[0], []).append(word[1:])
    return f"(?<![a-z0-9])(?:{'|'.join(f'{first}(?:{"|".join(rest)})' for first, rest in rests.items())})(?![a-z0-9])"


def line_size(line: Column, idf: dict[str, float], other: float) -> Column:
    """The norm `r` of a line's template words and a lower bound `q` of the squared norm of its others.

    n words of which d are different have a sum of squared counts of n * n / d at least.
    """
    vocabulary = F.array(*[F.lit(w) for w in idf])
    weight = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])

    def sizes(w: Column) -> Column:
        def add(s: Column, word: Column) -> Column:
            n = F.size(w) - F.size(F.array_remove(w, word))
            return F.struct((s["r"] + F.pow(n * weight[word], 2)).alias("r"), (s["known"] + n).alias("known"))

        def finish(s: Column) -> Column:
            d = F.greatest(F.size(F.array_except(w, vocabulary)), F.lit(1))
            return F.struct(F.sqrt(s["r"]).alias("r"), (F.pow((F.size(w) - s["known"]) * other, 2) / d).alias("q"))

        return F.aggregate(F.array_intersect(w, vocabulary), F.struct(F.lit(0.0).alias("r"), F.lit(0).alias("known")), add, finish)

    return F.transform(F.array(words(line)), sizes)[0]


def window_ends(near: Column, threshold: float) -> Column:
    """Numbers of lines of the windows at the start of `near` (line, filled, anchor, size) that can be notices.

    A window ends with a line that has words, has a line that passed the word test, and its sizes leave the
    threshold in reach: its template words have at most the sum of its lines' norms, its other words at least
    the sum of their squared norms.
    """

    def add(s: Column, line: Column) -> Column:
        n, r, q = s["n"] + 1, s["r"] + line["size"]["r"], s["q"] + line["size"]["q"]
        some = s["some"] | line["anchor"]
        enough = (1 - threshold**2) * r * r >= threshold**2 * (1 - 1e-9) * q
        ends = F.when(some & enough & line["filled"], F.concat(s["ends"], F.array(n))).otherwise(s["ends"])
        return F.struct(n.alias("n"), r.alias("r"), q.alias("q"), some.alias("some"), ends.alias("ends"))

    start = F.struct(
        F.lit(0).alias("n"), F.lit(0.0).alias("r"), F.lit(0.0).alias("q"), F.lit(False).alias("some"),
        F.array().cast("array<int>").alias("ends"),
    )
    return F.aggregate(near, start, add, lambda s: s["ends"])


def units(
    files: DataFrame, header_test: str, file_test: str, idf: dict[str, float], other: float, threshold: float,
    window: int = WINDOW,
) -> DataFrame:
    """(path, named, file_words, line_no, lines, text) of the windows and whole texts that can be notices.

    One pass over the files. Each line is measured once and looks at the next ones while its file is one
    row, so no file is gathered or sorted; only starts of windows that can be notices leave it. `file_test`
    has all words of `header_test`. Whole texts of up to `window` lines are windows already.
    """

    def passes(text) -> Column:
        low = F.lower(text)
        return F.coalesce(F.when(F.col("named"), low.rlike(file_test)).otherwise(low.rlike(header_test)), F.lit(False))

    def measured(line: Column) -> Column:
        return F.struct(
            line.alias("line"), F.lower(line).rlike(WORD).alias("filled"), passes(line).alias("anchor"),
            line_size(line, idf, other).alias("size"),
        )

    def begin(line: Column, at: Column) -> Column:
        near = F.slice("parts", at + 1, F.lit(window))
        ends = F.when(line["filled"] & F.exists(near, lambda x: x["anchor"]), window_ends(near, threshold))
        return F.struct((at + 1).alias("line_no"), ends.alias("ends"), F.transform(near, lambda x: x["line"]).alias("near"))

    maybe = files.withColumn("named", F.col("path").rlike(LICENSE_NAME)).where(passes("text"))
    maybe = maybe.withColumn("parts", F.transform(F.split("text", "\n", -1), measured))
    whole = F.struct(F.lit(1).alias("line_no"), F.array(F.size("parts")).alias("ends"), F.array("text").alias("near"))
    starts = F.concat(
        F.filter(F.transform("parts", begin), lambda x: F.size(x["ends"]) > 0),
        F.when(F.col("named") & (F.size("parts") > window), F.array(whole)).otherwise(F.array()),
    )
    rows = maybe.select("path", "named", F.size(words("text")).alias("file_words"), F.explode(starts).alias("s"))
    rows = rows.select("path", "named", "file_words", "s.line_no", "s.near", F.explode("s.ends").alias("lines"))
    text = F.array_join(F.slice("near", F.lit(1), F.col("lines")), "\n")
    return rows.select("path", "named", "file_words", "line_no", "lines", text.alias("text"))


def notices(
    files: DataFrame, threshold: float = 0.7, templates=TEMPLATES, license_texts=LICENSE_TEXTS, window: int = WINDOW
) -> DataFrame:
    """(path, line_no, lines, license, cosine, unit_words, file_words) of every unit that is a notice; lines count from 1.

    `file_words` are the words of its file, of the shortest one if several have the path.
    """
    spark = files.sparkSession
    templates, n_headers = (*templates, *license_texts), len(templates)
    counted = template_words(templates)
    vocabulary = sorted({w for c in counted for w in c})
    total, frequency = document_frequencies(files, vocabulary)
    idf = {w: math.log((1 + total) / (1 + frequency.get(w, 0))) + 1 for w in vocabulary}
    other = sum(idf.values()) / max(len(idf), 1)
    weights = [{w: n * idf[w] for w, n in c.items()} for c in counted]
    norms = [math.sqrt(sum(x * x for x in w.values())) for w in weights]
    # One row for each word of each template: bounded by the templates given.
    rows = [
        (i, templates[i][0], i >= n_headers, word, idf[word], x / norms[i])
        for i, w in enumerate(weights)
        for word, x in w.items()
    ]
    table = F.broadcast(
        spark.createDataFrame(
            rows, "template int, license string, file_only boolean, word string, idf double, share double"
        )
    )
    idfs = F.broadcast(spark.createDataFrame(sorted(idf.items()), "word string, idf double"))
    tests = [_any_of(anchors(w, idf, threshold)) for w in (weights[:n_headers], weights)]
    maybe = units(files, *tests, idf, other, threshold, window)
    key = ["path", "line_no", "lines"]
    counts = (
        maybe.select(*key, "named", "file_words", F.explode(words("text")).alias("word"))
        .groupBy(*key, "named", "word")
        .agg(F.count("*").alias("n"), F.min("file_words").alias("file_words"))
    )
    counts = stored(counts, "notice-words")
    size = (
        counts.join(idfs, "word", "left")
        .groupBy(*key)
        .agg(
            F.sqrt(F.sum(F.pow(F.col("n") * F.coalesce("idf", F.lit(other)), 2))).alias("norm"),
            F.sum("n").alias("unit_words"),
            F.min("file_words").alias("file_words"),
        )
    )
    dots = (
        counts.join(table, "word")
        .where("named OR NOT file_only")
        .groupBy(*key, "template", "license")
        .agg(F.sum(F.col("n") * F.col("idf") * F.col("share")).alias("dot"))
    )
    near = dots.join(size, key).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 12)).where(F.col("cosine") >= threshold)
    best = F.max_by(F.struct("license", "cosine"), F.struct("cosine", (-F.col("template")).alias("t"))).alias("best")
    sizes = [F.first(c).alias(c) for c in ("unit_words", "file_words")]
    return near.groupBy(*key).agg(best, *sizes).select(*key, "best.license", "best.cosine", "unit_words", "file_words")


def folder(path: Column) -> Column:
    """The directory of a path, without a slash at its end; the empty text is the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), "")


def _ancestors(directory: Column) -> Column:
    """Every directory from the root down to the given one, with its depth."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above"), n.alias("depth")),
    )


def scan(
    files: DataFrame,
    threshold: float = 0.7,
    file_share: float = 0.5,
    templates=TEMPLATES,
    license_texts=LICENSE_TEXTS,
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of `files` (path, text; other columns stay): license, origin, cosine, line_no, lines, source_path.

    `origin` is header (a notice in the file; one that names a licence before a mere reservation of
    rights, then the most similar one, the first, the shortest; it has `lines` lines from `line_no` on),
    inherited (from the licence file `source_path` of the nearest directory above) or none. Of several
    licence files in a directory one that names a licence counts first, then the most similar, then the
    smallest path. Paths name files: repeated rows with one path are scanned together. A null
    text has no words; a null path has no directory, is not scanned and gets none. A file named like a
    licence that resembles no template holds for nothing. Columns with the added names are replaced.
    """
    added = ["license", "origin", "cosine", "line_no", "lines", "source_path"]
    files = files.drop(*added)
    known = files.where("path IS NOT NULL").select("path", F.coalesce("text", F.lit("")).alias("text"))
    found = notices(known, threshold, templates, license_texts, window)
    order = F.struct((F.col("license") != RESERVED).alias("names"), "cosine", (-F.col("line_no")).alias("t"), (-F.col("lines")).alias("s"))
    notice = F.struct("license", "cosine", "line_no", "lines", "unit_words", "file_words")
    own = stored(found.groupBy("path").agg(F.max_by(notice, order).alias("own")), "own")
    own_side = F.broadcast(own) if fits_broadcast(own) else own
    mostly = F.col("own.unit_words") >= file_share * F.col("own.file_words")
    holders = own.where(mostly | F.col("path").rlike(LICENSE_NAME)).select(
        folder(F.col("path")).alias("above"), "path", "own.license", "own.cosine"
    )
    first = F.min_by(F.struct("license", "path"), F.struct((F.col("license") == RESERVED).alias("r"), (-F.col("cosine")).alias("c"), "path")).alias("held")
    held = holders.withColumn("above", F.regexp_replace(F.regexp_replace("above", "/+", "/"), "^/", "")).groupBy("above").agg(first)
    folders = known.select(folder(F.col("path")).alias("dir")).distinct()
    nearest = stored(
        folders.select("dir", F.explode(_ancestors(F.col("dir"))).alias("up"))
        .select("dir", "up.above", "up.depth")
        .join(held, "above")
        .groupBy("dir")
        .agg(F.max_by("held", "depth").alias("from")),
        "nearest",
    )
    nearest_side = F.broadcast(nearest) if fits_broadcast(nearest) else nearest
    at, dir_, near, own_, from_ = (free_name(files, c) for c in ("_path", "_dir", "_near", "_own", "_from"))
    joined = (
        files.withColumn(dir_, folder(F.col("path")))
        .join(own_side.select(F.col("path").alias(at), F.col("own").alias(own_)), F.col("path") == F.col(at), "left")
        .join(nearest_side.select(F.col("dir").alias(near), F.col("from").alias(from_)), F.col(dir_) == F.col(near), "left")
    )
    has = F.col(own_).isNotNull()
    return joined.withColumns(
        {
            "license": F.coalesce(f"{own_}.license", f"{from_}.license"),
            "origin": F.when(has, "header").when(F.col(from_).isNotNull(), "inherited").otherwise("none"),
            "cosine": F.col(f"{own_}.cosine"),
            "line_no": F.col(f"{own_}.line_no"),
            "lines": F.col(f"{own_}.lines"),
            "source_path": F.when(~has, F.col(f"{from_}.path")),
        }
    ).drop(dir_, at, near, own_, from_)
