"""Document quality by regularised quadratic discriminant analysis.

Each class is a Gaussian over transformed statistics of the text. Its covariance is shrunk towards
the pooled diagonal, so that a statistic that hardly varies within a class does not dominate. A
document's score is the logistic of the difference of the two log densities plus the log odds of the
classes; the Mahalanobis terms use Cholesky factors computed once.

Means and covariances are sums over all labelled rows, taken by Spark; only the two class moments
reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tabulon.llm.common import lean

STATISTICS = (
    "log_chars", "log_words", "word_length", "unique_words", "upper", "digits", "symbols", "commonest_symbol",
    "bare_symbols", "stops", "log_line", "repeated_lines", "mixed_words", "vowels",
)
#: Statistics are standardised and bounded, so that a rare text does not decide by its extremity alone.
BOUND = 5.0
_CLASS_OF = np.zeros(0x250, np.uint8)  # 1 upper case, 2 lower case, 3 digit, 4 blank, 5 symbol
for _c in range(0x250):
    _s = chr(_c)
    _CLASS_OF[_c] = 1 if _s.isupper() else 2 if _s.isalpha() else 3 if _s.isdigit() else 4 if _s.isspace() else 5
_IS_VOWEL = np.isin(np.arange(0x250), [ord(x) for x in "aeiouyäöüàâéèêëîïôûùáíóúAEIOUYÄÖÜÉÈÊÁÍÓÚ"])
_MIXED = re.compile(r"[^\W\d_]+[^\w\s.,;:'-]")


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text; a null text counts as empty."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    known = codes[codes < 0x250]
    kinds = np.bincount(_CLASS_OF[known], minlength=6).astype(float)
    letters = kinds[1] + kinds[2] + (len(codes) - len(known))
    shown = max(len(codes) - kinds[4], 1.0)
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    symbol_counts = np.bincount(known[_CLASS_OF[known] == 5], minlength=1)
    ends = sum(w[-1] in ".," for w in words)
    share = lambda count, of: np.log((count + 0.1) / (of + 10.0))
    return np.array(
        [
            np.log1p(len(codes)),
            np.log1p(len(words)),
            np.log1p(shown / n),
            len(set(words)) / n,
            share(kinds[1], letters),
            share(kinds[3], shown),
            share(kinds[5], shown),
            share(symbol_counts.max(), shown),
            share(sum(len(w) == 1 and not w.isalnum() for w in words), n),
            share(ends, n),
            np.log1p(len(codes) / max(len(lines), 1)),
            share(len(lines) - len(set(lines)), len(lines)),
            share(len(_MIXED.findall(text)), n),
            share(np.count_nonzero(_IS_VOWEL[known]), letters),
        ]
    )


def with_statistics(docs: DataFrame, added: str = "statistics", text: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    @lean
    def measured(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([statistics(x) for x in batch], dtype=object)

    return docs.withColumn(added, measured(F.col(text).cast("string")))


@dataclass
class Discriminant:
    """Class means and inverse Cholesky factors on standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offset: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -BOUND, BOUND)
        far = [np.square((z - m) @ f.T).sum(axis=1) for m, f in zip(self.means, self.factors)]
        odds = self.offset + 0.5 * (far[0] - far[1])
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -700, 700)))


def _moments(rows: DataFrame, columns: list[Column]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of each label."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    named = rows.select("label", *[c.alias(f"s{i}") for i, c in enumerate(columns)])
    found = (
        named.groupBy("label")
        .agg(
            F.count("*").alias("n"),
            *[F.avg(f"s{i}").alias(f"m{i}") for i in range(k)],
            *[F.covar_pop(f"s{i}", f"s{j}").alias(f"c{i}_{j}") for i, j in pairs],
        )
        .collect()
    )
    out = {}
    for r in found:
        cov = np.zeros((k, k))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        out[r["label"]] = (float(r["n"]), np.array([r[f"m{i}"] for i in range(k)]), cov)
    return out


def fit(rows: DataFrame, column: str = "statistics", shrinkage: float = 0.1) -> Discriminant:
    """Fit on all rows of `rows` (label 0 or 1, statistics). Without any row every score is one half."""
    k = len(STATISTICS)
    raw = [F.col(column)[i] for i in range(k)]
    found = _moments(rows, raw)
    if not found:
        return Discriminant(np.zeros(k), np.ones(k), np.zeros((2, k)), np.stack([np.eye(k)] * 2), 0.0)
    total = sum(n for n, _, _ in found.values())
    centre = sum(n * m for n, m, _ in found.values()) / total
    spread = sum(n * (np.diag(c) + np.square(m - centre)) for n, m, c in found.values()) / total
    scale = np.sqrt(np.maximum(spread, 1e-8))
    z = [F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), (x - m) / s)) for x, m, s in zip(raw, centre.tolist(), scale.tolist())]
    found = _moments(rows, z)
    pooled = sum(n * np.diag(c) for n, _, c in found.values()) / total
    none = (0.0, np.zeros(k), np.zeros((k, k)))
    means, factors, logs = [], [], []
    for label in (0, 1):
        n, mean, cov = found.get(label, none)
        weight = shrinkage + (1 - shrinkage) * k / (k + n)  # a class with few rows leans on the pooled diagonal
        cov = (1 - weight) * cov + weight * np.diag(pooled) + 1e-3 * np.eye(k)
        lower = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        logs.append(np.log(n + 1) - np.log(np.diag(lower)).sum())
    return Discriminant(centre, scale, np.stack(means), np.stack(factors), float(logs[1] - logs[0]))


def with_scores(docs: DataFrame, model: Discriminant, text: str | None = "text", column: str | None = None) -> DataFrame:
    """Adds `score` and `predicted`, from whole texts or from stored statistics (`column`).

    Columns of those names are replaced, all others stay. Null and empty texts have the statistics
    of an empty text, and so a score.
    """

    @F.pandas_udf("double")
    @lean
    def score(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in values:
            rows = [v if column else statistics(v) for v in batch]
            yield pd.Series(model.scores(np.array(rows, dtype=float)) if rows else [], dtype=float)

    source = F.col(column) if column else F.col(text).cast("string")
    return docs.withColumn("score", score(source)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
