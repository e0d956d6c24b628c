"""Feature preparation. Parameters always come from `train` and are applied to `df`.

Parameters with a fixed number of values are read through scalar subqueries, so an operator stays
one lazy plan. Parameters with one row per category are joined by `lookup`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulon.functions.columns import (
    col,
    family,
    literal_rows,
    long_aggregate,
    number,
    numeric_columns,
    pearson,
    present,
    union_all,
)
from tabulon.operators.lookup import fits_broadcast, lookup, lookup_counted
from tabulon.operators.ordering import positions
from tabulon.operators.profile import cramers_v, iqr_bounds, target_numeric, tokens
from tabulon.operators.quantiles import quantile_scalars, quantile_table
from tabulon.session import materialize

ONE_HOT_LIMIT = 20


def _mode(train: DataFrame, column: str) -> Column:
    counts = train.select(present(train, column).alias("v")).where("v is not null").groupBy("v").count()
    return counts.agg(F.min(F.struct((-F.col("count")).alias("n"), "v"))["v"].alias("v")).scalar()


def impute(train: DataFrame, df: DataFrame, column: str, strategy: str, fill=None) -> DataFrame:
    """Fill missing values with the train mean, median or mode, or with `fill` for constant.

    Adds `<column>_missing`, 1 where the value was missing.
    """
    if strategy == "mean":
        value = train.agg(F.avg(number(train, column)).alias("v")).scalar()
    elif strategy == "median":
        value = quantile_scalars(train, column, [0.5])[0]
    elif strategy == "mode":
        value = _mode(train, column)
    elif strategy == "constant":
        value = F.lit(fill)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    kept = number(df, column) if strategy in ("mean", "median") else present(df, column)
    return df.withColumns(
        {column: F.coalesce(kept, value), f"{column}_missing": present(df, column).isNull().cast("int")}
    )


def category_index(train: DataFrame, column: str) -> DataFrame:
    """`<column>, index`: 0 for the most frequent train value; ties by value."""
    counts = materialize(
        train.select(present(train, column).alias(column))
        .where(col(column).isNotNull())
        .groupBy(column)
        .agg((-F.count("*")).alias("_rank")),
        "categories",
    )
    if fits_broadcast(counts):
        # The measured size bounds what this single sort holds.
        at = F.row_number().over(W.orderBy("_rank", column)).cast("long") - 1
        return counts.select(column, at.alias("index"))
    ranked = positions(counts, [], ["_rank", column], "index")
    return ranked.select(column, (F.col("index") - 1).alias("index"))


def index_encode(train: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Add `<column>_index`; values unseen in train, and nulls, get the next free index."""
    index = materialize(category_index(train, column), "index")
    size = index.agg(F.count("*").alias("n")).scalar()
    out = lookup(df, index, [column], stored=True)
    return out.select(*[col(c) for c in df.columns], F.coalesce("index", size).alias(f"{column}_index"))


def one_hot(train: DataFrame, df: DataFrame, column: str, limit: int = ONE_HOT_LIMIT) -> DataFrame:
    """Add one 0/1 column per train value, named `<column>_<value>`.

    Only for columns of at most `limit` values; frequency or target encoding serve wider ones.
    """
    seen = train.select(present(train, column).alias("v")).where("v is not null").distinct()
    values = sorted(r["v"] for r in seen.limit(limit + 1).collect())
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} values; use an encoding with one column")
    return df.withColumns(
        {f"{column}_{v}": F.coalesce((col(column) == v).cast("int"), F.lit(0)) for v in values}
    )


def frequency_encode(train: DataFrame, df: DataFrame, column: str) -> DataFrame:
    """Add `<column>_freq`: the share of train rows with this value; 0 for unseen values."""
    total = train.agg(F.count(present(train, column)).alias("n")).scalar()
    table = (
        train.select(present(train, column).alias(column))
        .where(col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("_n"))
        .select(column, F.try_divide(F.col("_n"), total).alias("_share"))
    )
    out = lookup(df, table, [column])
    return out.select(
        *[col(c) for c in df.columns], F.coalesce("_share", F.lit(0.0)).alias(f"{column}_freq")
    )


def target_encode(
    train: DataFrame, df: DataFrame, column: str, target: str, m: float = 10.0
) -> DataFrame:
    """Add `<column>_target`: (sum + m * mean) / (n + m) over train; the mean for unseen values."""
    mean = train.agg(F.avg(number(train, target)).alias("mean")).scalar()
    known = train.select(present(train, column).alias(column), number(train, target).alias("_y"))
    table = (
        known.where(col(column).isNotNull() & F.col("_y").isNotNull())
        .groupBy(column)
        .agg(F.sum("_y").alias("_s"), F.count("*").alias("_n"))
        .select(column, ((F.col("_s") + m * mean) / (F.col("_n") + m)).alias("_code"))
    )
    out = lookup(df, table, [column])
    return out.select(
        *[col(c) for c in df.columns], F.coalesce("_code", mean).alias(f"{column}_target")
    )


def _scale(train, df, columns, suffix, aggregates, formula) -> DataFrame:
    packed = train.agg(
        F.struct(
            *[
                F.struct(*[make(number(train, c)).alias(n) for n, make in aggregates.items()]).alias(f"c{i}")
                for i, c in enumerate(columns)
            ]
        ).alias("p")
    ).scalar()
    return df.withColumns(
        {
            f"{c}_{suffix}": formula(number(df, c), lambda n, i=i: packed[f"c{i}"][n])
            for i, c in enumerate(columns)
        }
    )


def standardize(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add `<column>_z`: (x - mean) / sample std; 0 where train has no spread."""
    return _scale(
        train, df, columns, "z", {"mean": F.avg, "std": F.stddev_samp},
        lambda x, p: F.coalesce(F.try_divide(x - p("mean"), p("std")), x - x),
    )


def minmax_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add `<column>_01`: the value's place between the train minimum (0) and maximum (1)."""
    return _scale(
        train, df, columns, "01", {"lo": F.min, "hi": F.max},
        lambda x, p: F.coalesce(F.try_divide(x - p("lo"), p("hi") - p("lo")), x - x),
    )


def maxabs_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add `<column>_abs`: the value over the largest train magnitude."""
    return _scale(
        train, df, columns, "abs", {"top": lambda c: F.max(F.abs(c))},
        lambda x, p: F.coalesce(F.try_divide(x, p("top")), x - x),
    )


def robust_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add `<column>_robust`: (x - median) / interquartile range."""
    out = df
    for c in columns:
        q1, q2, q3 = quantile_scalars(train, c, [0.25, 0.5, 0.75])
        x = number(df, c)
        out = out.withColumn(f"{c}_robust", F.coalesce(F.try_divide(x - q2, q3 - q1), x - x))
    return out


def l2_normalize(df: DataFrame, column: str) -> DataFrame:
    """Replace an array column by the array divided by its Euclidean length."""
    x = F.transform(col(column), lambda v: v.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    unit = F.transform(x, lambda v: F.coalesce(F.try_divide(v, length), F.lit(0.0)))
    return df.withColumn(column, unit)


def clip_outliers(train: DataFrame, df: DataFrame, column: str, method: str = "clip") -> DataFrame:
    """Apply the train IQR bounds: `clip` the values, `filter` the rows, or add `<column>_outlier`."""
    lower, upper = iqr_bounds(train, [column])[column]
    x = number(df, column)
    if lower is None:
        return df if method != "flag" else df.withColumn(f"{column}_outlier", F.lit(0))
    if method == "clip":
        return df.withColumn(column, F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(upper)), F.lit(lower))))
    outside = (x < lower) | (x > upper)
    if method == "filter":
        return df.where(x.isNull() | ~outside)
    if method == "flag":
        return df.withColumn(f"{column}_outlier", F.coalesce(outside.cast("int"), F.lit(0)))
    raise ValueError(f"unknown method {method!r}")


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """Add year, month, day, weekday (0 = Sunday) and weekend columns."""
    weekday = F.dayofweek(col(column)) - 1
    return df.withColumns(
        {
            f"{column}_year": F.year(col(column)),
            f"{column}_month": F.month(col(column)),
            f"{column}_day": F.day(col(column)),
            f"{column}_weekday": weekday,
            f"{column}_weekend": weekday.isin(0, 6).cast("int"),
        }
    )


DERIVATIONS = ("log1p", "square", "ratio", "product", "difference")


def derive(df: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """Create numeric columns: ("log1p", a), ("square", a), ("ratio" | "product" | "difference", a, b).

    A ratio by zero and the logarithm of a value not above -1 are missing, not errors.
    """
    made = {}
    for kind, *names in steps:
        x = [number(df, c) for c in names]
        made["_".join([*names, kind])] = {
            "log1p": lambda: F.when(x[0] > -1, F.log1p(x[0])),
            "square": lambda: x[0] * x[0],
            "ratio": lambda: F.try_divide(x[0], x[1]),
            "product": lambda: x[0] * x[1],
            "difference": lambda: x[0] - x[1],
        }[kind]()
    return df.withColumns(made)


def bin_column(
    train: DataFrame, df: DataFrame, column: str, bins: int, method: str = "equal_width"
) -> DataFrame:
    """Add `<column>_bin` in 0..bins-1, with edges from train; outer bins are open-ended."""
    x = number(df, column)
    if method == "equal_width":
        s = train.agg(
            F.struct(F.min(number(train, column)).alias("lo"), F.max(number(train, column)).alias("hi")).alias("s")
        ).scalar()
        at = F.floor(F.try_divide(x - s["lo"], (s["hi"] - s["lo"]) / bins))
        placed = F.greatest(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)), F.lit(0))
    elif method == "quantile":
        edges = [
            r["value"]
            for r in quantile_table(train, [column], [i / bins for i in range(1, bins)]).collect()
        ]
        placed = F.lit(0)
        for e in edges:
            placed = placed + (x >= F.lit(e)).cast("int")
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumn(f"{column}_bin", F.when(x.isNotNull(), placed.cast("int")))


def select_features(profiled: DataFrame, pairs: DataFrame, high_missing: float = 0.6, twin: float = 0.95) -> DataFrame:
    """`column, selected, reason` from a profile and a correlation table.

    Dropped: constants, ids, complex columns, columns missing too often, and of two near-duplicate
    columns (|r| above `twin`) the later name. Both inputs have one row per column or column pair.
    """
    twins = (
        pairs.where(F.abs("r") > twin)
        .groupBy(F.greatest("a", "b").alias("column"))
        .agg(F.min(F.least("a", "b")).alias("twin"))
    )
    kind = F.col("kind")
    reason = (
        F.when(kind.isin("constant", "id", "complex"), kind)
        .when(F.col("missing_share") > high_missing, "missing")
        .when(F.col("twin").isNotNull(), F.concat(F.lit("duplicate of "), F.col("twin")))
    )
    return profiled.join(twins, "column", "left").select(
        "column", reason.isNull().alias("selected"), reason.alias("reason")
    )


def rank_features(df: DataFrame, target: str, k: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Top-k columns by univariate score against a numeric target, best first.

    Score: r² for numeric columns, eta² for string columns.
    """
    numbers = [c for c in (columns or numeric_columns(df)) if c in numeric_columns(df) and c != target]
    strings = [c for c in (columns or []) if c not in numbers and c != target]
    y = number(df, target)
    frames = []
    if numbers:
        r2 = long_aggregate(df, numbers, {"r": lambda c: pearson(number(df, c), y)})
        frames.append(r2.select("column", (F.col("r") * F.col("r")).alias("score")))
    for c in strings:
        frames.append(target_numeric(df, target, c).agg(F.first("eta2").alias("score")).select(F.lit(c).alias("column"), "score"))
    # One row per column.
    order = W.orderBy(F.desc_nulls_last("score"), "column")
    return union_all(frames).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_categories(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Cramér's V of each categorical column against a categorical target, best first."""
    frames = [
        cramers_v(df, c, target).select(F.lit(c).alias("column"), F.col("cramers_v").alias("score"))
        for c in columns
    ]
    order = W.orderBy(F.desc_nulls_last("score"), "column")
    return union_all(frames).withColumn("rank", F.row_number().over(order))


def term_counts(df: DataFrame, key: str, column: str) -> DataFrame:
    """`key, term, tf` over lower-cased whitespace tokens.

    Tokens are counted within their row, as runs of equal ones in sorted order, so that rows are shuffled
    only if a key has several of them.
    """
    found = df.select(col(key).alias("k"), F.sort_array(tokens(F.lower(col(column)))).alias("t"))
    # Where a run begins, numbered from 1; nothing for a text without tokens.
    places = F.when(F.size("t") > 0, F.sequence(F.lit(1), F.size("t")))
    begins = F.filter(places, lambda i: (i == 1) | (F.get("t", i - 1) != F.get("t", i - 2)))
    runs = found.select("k", "t", begins.alias("b"))
    ends = F.concat(F.slice("b", 2, F.size("b")), F.array(F.size("t") + 1))
    pair = F.zip_with("b", ends, lambda b, e: F.struct(F.get("t", b - 1).alias("term"), (e - b).cast("long").alias("tf")))
    counts = runs.select("k", F.explode(pair).alias("c")).select(F.col("k").alias(key), "c.term", "c.tf")
    if df.groupBy(col(key)).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return counts
    return counts.groupBy(col(key), "term").agg(F.sum("tf").alias("tf"))


def text_features(df: DataFrame, key: str, column: str) -> DataFrame:
    """`key, term, tf, df, tfidf` over lower-cased whitespace tokens of whole texts.

    idf = ln((documents + 1) / (df + 1)). Terms found in many documents are broadcast, as many as fit,
    and only rows of the others are shuffled to their term's frequency.
    """
    terms = materialize(term_counts(df, key, column), "terms")
    docs = df.agg(F.count(col(column)).alias("n")).scalar()
    frequency = materialize(terms.groupBy("term").agg(F.count("*").alias("df")), "frequency")
    out = lookup_counted(terms, frequency, "term", "df")
    idf = F.ln((docs + 1) / (F.col("df") + 1))
    return out.select(key, "term", "tf", "df", (F.col("tf") * idf).alias("tfidf"))


def guard(df: DataFrame, target: str | None = None) -> DataFrame:
    """Reasons why a table cannot be used as it is, one row each: `problem, column, fatal`."""
    spark = df.sparkSession
    found = [("unsupported type", f.name, False) for f in df.schema.fields if family(f.dataType) == "complex"]
    if target is not None and target not in df.columns:
        found.append(("target column not found", target, True))
    empty = df.limit(1).agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit("dataset is empty").alias("problem"), F.lit(None).cast("string").alias("column"), F.lit(True).alias("fatal")
    )
    if not found:
        return empty
    return literal_rows(spark, found, "problem string, column string, fatal boolean").unionByName(empty)
