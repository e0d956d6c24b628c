"""Exact quantiles without moving the data.

`percentile` keeps every distinct value of a column in one task. Here a sketch brackets each wanted
quantile, a second pass counts the values below the bracket, and only the values inside it are
grouped and ranked. With the default accuracy a bracket holds about 1 in 5,000 of the rows, so what
is shuffled stays a small share of the input, and the answer is the exact interpolated quantile.
Ranking is done in range slices over all brackets together, so no bracket, however large, becomes
one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.columns import chunks, literal_rows, number, union_all
from tabulon.operators.ordering import running_totals

ACCURACY = 20_000


def quantile_table(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Long table `column, prob, value`; null value where a column has no values.

    Linear interpolation between the two nearest ranks, as `percentile` does.
    """
    per_pass = max(1, 120 // len(probs))
    return union_all([_pass(df, part, probs, accuracy) for part in chunks(columns, per_pass)])


def _percentile(df: DataFrame, columns: list[str], probs: Sequence[float]) -> DataFrame:
    row = df.agg(
        *[F.percentile(number(df, c), list(probs)).alias(f"v{i}") for i, c in enumerate(columns)]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(float(p)).alias("prob"),
            F.get(F.col(f"v{i}"), F.lit(j)).alias("value"),
        )
        for i, c in enumerate(columns)
        for j, p in enumerate(probs)
    ]
    return row.select(F.inline(F.array(*rows)))


def _pass(
    df: DataFrame, columns: list[str], probs: Sequence[float], accuracy: int, whole: bool = False
) -> DataFrame:
    """One round over some columns; `whole` ranks all values instead of those inside the brackets."""
    margin = 2.0 / accuracy
    cuts = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    values = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    # One row, bounded by the number of columns and quantiles asked for.
    sketch = values.agg(
        *[
            F.struct(
                F.count(f"v{i}").alias("n"),
                F.min(f"v{i}").alias("min"),
                F.max(f"v{i}").alias("max"),
                F.percentile_approx(f"v{i}", cuts, accuracy).alias("cuts"),
            ).alias(f"v{i}")
            for i in range(len(columns))
        ]
    ).first()

    # The bracket is wider than the sketch's error by n / accuracy ranks. Where that is less than a
    # few ranks, the two neighbours of a quantile could lie outside; such columns have few values, and
    # `percentile` holds at most those.
    few = [c for i, c in enumerate(columns) if sketch[f"v{i}"]["n"] <= 4 * accuracy]
    if few:
        frames = [_percentile(df, few, probs)]
        rest = [c for c in columns if c not in few]
        return union_all([*frames, _pass(df, rest, probs, accuracy)]) if rest else frames[0]

    slots, requested = [], []
    for i, name in enumerate(columns):
        s = sketch[f"v{i}"]
        for j, p in enumerate(probs):
            slot = len(requested)
            requested.append((slot, name, float(p), (s["n"] - 1) * p))
            low = s["min"] if whole or cuts[j] <= 0 else s["cuts"][j]
            high = s["max"] if whole or cuts[len(probs) + j] >= 1 else s["cuts"][len(probs) + j]
            slots.append((slot, F.col(f"v{i}"), low, high))
    wanted = literal_rows(
        df.sparkSession, requested, "slot int, column string, prob double, at double"
    )

    below = values.agg(*[F.count_if(v < low).alias(f"b{k}") for k, v, low, _ in slots]).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("slot"), F.col(f"b{k}").alias("below"))
                    for k, _, _, _ in slots
                ]
            )
        )
    )
    hits = [(k, v, v.between(low, high)) for k, v, low, high in slots]
    inside = (
        values.where(reduce(or_, [hit for _, _, hit in hits]))
        .select(
            F.inline(
                F.array_compact(
                    F.array(
                        *[
                            F.when(hit, F.struct(F.lit(k).alias("slot"), v.alias("value")))
                            for k, v, hit in hits
                        ]
                    )
                )
            )
        )
        .groupBy("slot", "value")
        .count()
    )
    # `wanted` and `below` have one row per requested quantile, so broadcasting them is bounded by
    # the request itself.
    last = F.col("below") + F.col("upto") - 1
    first = last - F.col("count") + 1
    picked = (
        running_totals(inside, ["slot"], ["value"], {"upto": "count"})
        .join(F.broadcast(below), "slot")
        .join(F.broadcast(wanted.select("slot", "at")), "slot")
        .groupBy("slot")
        .agg(
            F.max(F.when(F.floor("at").between(first, last), F.col("value"))).alias("v0"),
            F.max(F.when(F.ceil("at").between(first, last), F.col("value"))).alias("v1"),
        )
    )
    exact = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.floor("at"))
    # One row per requested quantile.
    found = wanted.join(F.broadcast(picked), "slot", "left").select("column", "prob", exact.alias("value")).collect()
    outside = sorted({r["column"] for r in found if r["value"] is None})
    kept = [tuple(r) for r in found if r["column"] not in outside]
    answer = literal_rows(df.sparkSession, kept, "column string, prob double, value double")
    return answer.unionByName(_pass(df, outside, probs, accuracy, whole=True)) if outside else answer


def quantile_row(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """The same quantiles as one row: a struct per column, named by position, of q0, q1, ..."""
    table = quantile_table(df, columns, probs, accuracy)
    return table.agg(
        *[
            F.struct(
                *[
                    F.max(
                        F.when((F.col("column") == c) & (F.col("prob") == float(p)), F.col("value"))
                    ).alias(f"q{j}")
                    for j, p in enumerate(probs)
                ]
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )


def quantile_scalars(df: DataFrame, column: str, probs: Sequence[float]) -> list[Column]:
    """Quantiles of one column as scalar columns usable in any later projection."""
    packed = quantile_row(df, [column], probs).select("c0").scalar()
    return [packed[f"q{j}"] for j in range(len(probs))]
