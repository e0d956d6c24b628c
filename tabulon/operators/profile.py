"""Profiling: every operator returns a long table, one row per column or per (column, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabulon.functions.columns import (
    EXPRESSIONS_PER_PASS,
    chunks,
    col,
    columns_of,
    family,
    literal_rows,
    long_aggregate,
    number,
    numeric_columns,
    pearson,
    present,
    union_all,
)
from tabulon.functions.tails import chi_square_tail
from tabulon.operators.comoments import comoments, correlation_pairs, rank_pairs
from tabulon.operators.lookup import lookup
from tabulon.operators.quantiles import quantile_table
from tabulon.session import materialize

TOKEN_BREAK = r"[ \t\n\r\f]+"
TEXT_LENGTH = 50
FEW_VALUES = 20
DIGEST_FROM, DIGEST_MARK = 80, "\u0000"
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TIMESTAMP_PATTERN = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"
TYPE_SHARE = 0.99


def _types(df: DataFrame) -> dict:
    """The fixed facts about a column that its kind and its profile row start from."""
    return {
        "physical_type": lambda c: df.schema[c].dataType.simpleString(),
        "family": lambda c: family(df.schema[c].dataType),
    }


def _value_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`column, value` per non-null cell of columns of one type family."""
    rows = [F.struct(F.lit(c).alias("column"), _comparable(df, c).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*rows))).where("value is not null")


def _comparable(df: DataFrame, c: str) -> Column:
    """The value in its family's common type, without merging different values.

    Long texts are represented by their SHA-256 digest, so that whole texts are not shuffled.
    """
    dtype = df.schema[c].dataType
    fam = family(dtype)
    if fam == "integral":
        return col(c).cast("long")
    if fam == "datetime":
        return col(c).cast("timestamp_ntz") if dtype.typeName() != "timestamp" else col(c)
    if dtype.typeName() in ("float", "double"):
        return present(df, c)
    text = col(c).cast("string")
    digest = F.concat(F.lit(DIGEST_MARK), F.sha2(text, 256))
    return F.when(F.length(text) > DIGEST_FROM, digest).otherwise(text)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`column, distinct_count`, exact; null for complex columns.

    Cells of one family are grouped by (column, value): narrow keys, combined before the shuffle,
    instead of one aggregation whose keys hold every column.
    """
    groups: dict[str, list[str]] = {}
    for c in columns:
        fam = family(df.schema[c].dataType)
        if fam != "complex":
            name = df.schema[c].dataType.typeName() if fam in ("floating", "datetime") else fam
            groups.setdefault(name, []).append(c)
    counted = [
        _value_groups(df, part).distinct().groupBy("column").agg(F.count("*").alias("distinct_count"))
        for part in groups.values()
    ]
    every = literal_rows(
        df.sparkSession,
        [(c, None if family(df.schema[c].dataType) == "complex" else 0) for c in columns],
        "column string, zero long",
    )
    if not counted:
        return every.select("column", F.col("zero").alias("distinct_count"))
    # One row per column on both sides.
    return every.join(F.broadcast(union_all(counted)), "column", "left").select(
        "column", F.coalesce("distinct_count", "zero").alias("distinct_count")
    )


def _with_distinct(df: DataFrame, columns: Sequence[str], metrics: dict, exact: bool) -> DataFrame:
    """`long_aggregate` of the metrics, with the column's types and `distinct_count` added."""
    if exact:
        counts = distinct_counts(df, columns)
        return long_aggregate(df, columns, metrics, _types(df)).join(F.broadcast(counts), "column")
    approx = lambda c: (
        F.lit(None).cast("long")
        if family(df.schema[c].dataType) == "complex" else F.approx_count_distinct(present(df, c))
    )
    return long_aggregate(df, columns, {**metrics, "distinct_count": approx}, _types(df))


def _text_length(df: DataFrame):
    def length(c: str) -> Column:
        if family(df.schema[c].dataType) != "string":
            return F.lit(None).cast("double")
        return F.avg(F.length(col(c)))

    return length


def _kind() -> Column:
    fam = F.col("family")
    keyish = fam.isin("integral", "string")
    return (
        F.when(fam == "complex", "complex")
        .when(F.col("distinct_count") <= 1, "constant")
        .when(fam == "boolean", "boolean")
        .when(fam == "datetime", "datetime")
        .when(keyish & (F.col("distinct_count") == F.col("non_null")), "id")
        .when((fam == "string") & (F.col("mean_length") > TEXT_LENGTH), "text")
        .when(fam == "string", "categorical")
        .when((fam == "integral") & (F.col("distinct_count") <= FEW_VALUES), "categorical")
        .otherwise("numeric")
    )


def column_kinds(df: DataFrame, exact: bool = True) -> DataFrame:
    """`column, physical_type, kind` with the counts the kind was decided from.

    Kinds, first match wins: complex; constant (at most one value); boolean; datetime; id
    (integer or string, all non-null rows distinct); text (mean length above 50); categorical
    (string, or integer with at most 20 values); numeric.
    """
    columns = df.columns
    stats = _with_distinct(
        df,
        columns,
        {"non_null": lambda c: F.count(present(df, c)), "mean_length": _text_length(df)},
        exact,
    )
    return stats.select(
        "column",
        "physical_type",
        _kind().alias("kind"),
        "non_null",
        "distinct_count",
    )


def missing(df: DataFrame) -> DataFrame:
    """Null-or-NaN count and share per column. Complex columns are only tested for null."""
    stats = long_aggregate(
        df,
        df.columns,
        {"rows": lambda c: F.count("*"), "missing": lambda c: F.count_if(present(df, c).isNull())},
    )
    return stats.withColumn("missing_share", F.try_divide(F.col("missing"), F.col("rows")))


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """count, mean, sample std, min, q25, q50, q75, max per numeric column."""
    columns = list(columns or numeric_columns(df))
    metrics = {
        "count": lambda c: F.count(present(df, c)),
        "mean": lambda c: F.avg(number(df, c)),
        "std": lambda c: F.stddev_samp(number(df, c)),
        "min": lambda c: F.min(number(df, c)),
        "max": lambda c: F.max(number(df, c)),
    }
    if not exact:
        quartiles = lambda c: F.percentile_approx(number(df, c), [0.25, 0.5, 0.75], 10_000)
        stats = long_aggregate(df, columns, {**metrics, "q": quartiles})
        return _summary(stats.select("*", *[F.col("q")[i].alias(f"q{25 * (i + 1)}") for i in range(3)]))
    return _summary(_with_quartiles(df, long_aggregate(df, columns, metrics), columns))


def _summary(stats: DataFrame) -> DataFrame:
    return stats.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def _with_quartiles(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        null = F.lit(None).cast("double")
        return stats.select("*", null.alias("q25"), null.alias("q50"), null.alias("q75"))
    wide = quantile_table(df, columns, [0.25, 0.5, 0.75]).groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
          for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    # Both sides have one row per column.
    return stats.join(F.broadcast(wide), "column", "left")


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Population variance, skewness and excess kurtosis per numeric column."""
    return long_aggregate(
        df,
        list(columns or numeric_columns(df)),
        {
            "variance": lambda c: F.var_pop(number(df, c)),
            "skewness": lambda c: F.skewness(number(df, c)),
            "kurtosis": lambda c: F.kurtosis(number(df, c)),
        },
    )


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, mode, its count and its share per string column.

    Ties go to the smallest value. Long texts are counted by digest; only those that tie for the mode
    are fetched, and where every value occurs once, that is, all tie, no join is needed.
    """
    columns = list(columns or columns_of(df, "string", "boolean"))
    counts = _value_groups(df, columns).groupBy("column", "value").count()
    top = counts.groupBy("column").agg(
        F.count("*").alias("distinct_count"), F.sum("count").alias("n"), F.max("count").alias("mode_count")
    )
    cells = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"), _comparable(df, c).alias("value"), col(c).cast("string").alias("text")
                    )
                    for c in columns
                ]
            )
        )
    ).where(F.startswith("value", F.lit(DIGEST_MARK)))
    # `top` has one row per column.
    tied = counts.join(F.broadcast(top.select("column", "mode_count")), "column").where(F.col("count") == F.col("mode_count"))
    is_digest = F.startswith("value", F.lit(DIGEST_MARK))
    short = tied.where(~is_digest).select("column", F.col("value").alias("text"))
    repeated = cells.join(tied.where(is_digest & (F.col("mode_count") > 1)), ["column", "value"], "left_semi")
    single = cells.join(F.broadcast(top.where("mode_count = 1").select("column")), "column", "left_semi")
    texts = short.unionByName(repeated.select("column", "text")).unionByName(single.select("column", "text"))
    modes = texts.groupBy("column").agg(F.min("text").alias("mode"))
    return top.join(F.broadcast(modes), "column", "left").select(
        "column", "distinct_count", "mode", "mode_count", (F.col("mode_count") / F.col("n")).alias("mode_share")
    )


def datetime_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last day, days between them, and number of distinct days per datetime column."""
    stats = long_aggregate(
        df,
        list(columns or columns_of(df, "datetime")),
        {
            "first_day": lambda c: F.min(F.to_date(col(c))),
            "last_day": lambda c: F.max(F.to_date(col(c))),
            "distinct_days": lambda c: F.count_distinct(F.to_date(col(c))),
        },
    )
    return stats.withColumn("span_days", F.datediff("last_day", "first_day").cast("long"))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens, without empty ones."""
    return F.filter(F.split(text, TOKEN_BREAK), lambda t: t != "")


def text_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Length and token figures per text column, over whole texts."""
    blank = lambda c: ~col(c).rlike(r"[^ \t\n\r\f]")
    return long_aggregate(
        df,
        columns,
        {
            "n": lambda c: F.count(col(c)),
            "empty": lambda c: F.count_if(blank(c)),
            "min_length": lambda c: F.min(F.length(col(c))).cast("long"),
            "mean_length": lambda c: F.avg(F.length(col(c))),
            "max_length": lambda c: F.max(F.length(col(c))).cast("long"),
            "tokens": lambda c: F.sum(F.size(tokens(col(c)))).cast("long"),
        },
    )


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-null values per column and their share of the non-null rows."""
    stats = _with_distinct(
        df, list(columns or df.columns), {"non_null": lambda c: F.count(present(df, c))}, exact
    )
    share = F.try_divide(F.col("distinct_count"), F.col("non_null"))
    return stats.select("column", "non_null", "distinct_count", share.alias("distinct_share"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each non-null value, most frequent first; ties by value."""
    return _counts(df, column).orderBy(F.desc("count"), "value")


def most_frequent(df: DataFrame, column: str, k: int = 100) -> DataFrame:
    return _counts(df, column).orderBy(F.desc("count"), "value").limit(k)


def rarest(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return _counts(df, column).orderBy("count", "value").limit(k)


def n_unique(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(present(df, column)).alias("n_unique"))


def _counts(df: DataFrame, column: str) -> DataFrame:
    return df.select(present(df, column).alias("value")).where("value is not null").groupBy("value").count()


def quartiles(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, list]:
    """q25, q50 and q75 per column, fetched: three numbers per column."""
    if exact:
        table = quantile_table(df, columns, [0.25, 0.5, 0.75])
        found = {(r["column"], r["prob"]): r["value"] for r in table.collect()}
        return {c: [found[c, p] for p in (0.25, 0.5, 0.75)] for c in columns}
    out = {}
    for part in chunks(list(columns)):
        row = df.agg(
            *[F.percentile_approx(number(df, c), [0.25, 0.5, 0.75], 10_000) for c in part]
        ).first()
        out.update({c: row[i] or [None] * 3 for i, c in enumerate(part)})
    return out


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], k: float = 1.5, exact: bool = True
) -> dict[str, tuple]:
    """The quartiles moved out by k interquartile ranges, as (lower, upper) per column."""
    return {
        c: (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
        for c, (q1, _, q3) in quartiles(df, columns, exact).items()
    }


def _outside(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Count the values below and above the bounds of their column."""
    fixed = lambda i: lambda c: F.lit(bounds[c][i]).cast("double")
    return long_aggregate(
        df,
        list(bounds),
        {
            "n": lambda c: F.count(number(df, c)),
            "lower": lambda c: F.first(fixed(0)(c)),
            "upper": lambda c: F.first(fixed(1)(c)),
            "low": lambda c: F.count_if(number(df, c) < fixed(0)(c)),
            "high": lambda c: F.count_if(number(df, c) > fixed(1)(c)),
        },
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Bounds and the number of values below and above them, per numeric column."""
    return _outside(df, iqr_bounds(df, list(columns or numeric_columns(df)), k))


def zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, z: float = 3.0) -> DataFrame:
    """Values further than `z` sample standard deviations from the mean, per numeric column."""
    stats = long_aggregate(
        df,
        list(columns or numeric_columns(df)),
        {"mean": lambda c: F.avg(number(df, c)), "std": lambda c: F.stddev_samp(number(df, c))},
    )
    bounds = {
        r["column"]: (None, None)
        if r["std"] is None
        else (r["mean"] - z * r["std"], r["mean"] + z * r["std"])
        for r in stats.collect()
    }
    return _outside(df, bounds)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum belongs to the last bin."""
    values = df.select(number(df, column).alias("value")).where("value is not null")
    span = values.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("s")).scalar()
    placed = values.select("value", span.alias("s"))
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    at = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("s.lo"), width)), F.lit(0))
    bin_no = F.least(at, F.lit(bins - 1)).cast("int")
    return (
        placed.groupBy(bin_no.alias("bin"), "s")
        .count()
        .select(
            "bin",
            (F.col("s.lo") + F.col("bin") * width).alias("bin_from"),
            (F.col("s.lo") + (F.col("bin") + 1) * width).alias("bin_to"),
            "count",
        )
    )


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    return quantile_table(df, columns, probs)


def target_balance(df: DataFrame, target: str) -> DataFrame:
    """Per class: count and share; over all classes: largest/smallest ratio and entropy (nats)."""
    counts = _counts(df, target)
    n = F.col("count")
    whole = counts.agg(
        F.struct(
            F.sum(n).alias("n"),
            (F.max(n) / F.min(n)).alias("imbalance_ratio"),
            (F.ln(F.sum(n)) - F.sum(n * F.ln(n)) / F.sum(n)).alias("entropy"),
        ).alias("w")
    ).scalar()
    return counts.select("value", "count", whole.alias("w")).select(
        F.col("value").cast("string").alias("value"),
        "count",
        (n / F.col("w.n")).alias("share"),
        F.col("w.imbalance_ratio").alias("imbalance_ratio"),
        F.col("w.entropy").alias("entropy"),
    )


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns over the rows where both are present; one scan.

    Pairs that fit into one aggregation are aggregated without Python; more come from co-moments. `r` is null
    where a column has one value or no row has both.
    """
    columns = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not 0 < 3 * len(pairs) <= EXPRESSIONS_PER_PASS:
        return correlation_pairs(comoments(df, columns), columns).select("a", "b", "r")
    values = df.select(*[number(df, c).alias(c) for c in columns])
    flat = values.agg(*[pearson(col(a), col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)
    ]
    return flat.select(F.inline(F.array(*rows)))


def wide_correlations(df: DataFrame, columns: Sequence[str], method: str = "spearman") -> DataFrame:
    """Pairs as in `correlations`, over the rows without a missing value: of ranks, or of values ("pearson")."""
    if method == "spearman":
        return rank_pairs(df, columns).select("a", "b", "r")
    complete = df.select(*[number(df, c).alias(c) for c in columns]).na.drop()
    return correlations(complete, columns)


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of the a-by-b table and Cramér's V, over rows where both are present.

    chi2 = n * (sum(o^2 / (row total * column total)) - 1) needs only the cells that occur, so no
    row-by-column product is formed.
    """
    cells = (
        df.select(present(df, a).alias("a"), present(df, b).alias("b"))
        .where("a is not null and b is not null")
        .groupBy("a", "b")
        .agg(F.count("*").alias("o"))
    )
    cells = materialize(cells, "cells")
    rows = cells.groupBy("a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("c"))
    joined = lookup(lookup(cells, rows, ["a"]), cols, ["b"])
    whole = joined.agg(
        F.sum("o").alias("n"),
        F.sum(F.col("o") * F.col("o") / F.col("r") / F.col("c")).alias("s"),
        F.count_distinct("a").alias("levels_a"),
        F.count_distinct("b").alias("levels_b"),
    )
    chi2 = F.col("n") * (F.col("s") - 1)
    least = F.least("levels_a", "levels_b") - 1
    return whole.select(
        "n",
        "levels_a",
        "levels_b",
        chi2.alias("chi2"),
        F.sqrt(F.try_divide(F.greatest(F.col("s") - 1, F.lit(0.0)), least)).alias("cramers_v"),
    )


def chi_square_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """The test of independence of two columns: n, chi2, degrees of freedom and p-value, over rows with both.

    With one level on a side there is nothing to test: no degrees, and no p-value.
    """
    degrees = ((F.col("levels_a") - 1) * (F.col("levels_b") - 1)).alias("degrees")
    tested = cramers_v(df, a, b).select("n", "chi2", degrees, "cramers_v")
    p = F.when(F.col("degrees") > 0, chi_square_tail(F.greatest("chi2", F.lit(0.0)), F.col("degrees")))
    return tested.select("n", "chi2", "degrees", "cramers_v", p.alias("p_value"))


def target_numeric(df: DataFrame, column: str, target: str) -> DataFrame:
    """Count, mean and std of a numeric column per class, with eta² (between / total variance)."""
    x = F.col("x")
    groups = (
        df.select(present(df, target).alias("value"), number(df, column).alias("x"))
        .where("value is not null and x is not null")
        .groupBy("value")
        .agg(
            F.count("*").alias("n"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.var_pop(x).alias("v"),
        )
    )
    n, m = F.col("n"), F.col("mean")
    grand = F.sum(n * m) / F.sum(n)
    between = F.sum(n * m * m) - F.sum(n) * grand * grand
    within = F.sum(n * F.col("v"))
    eta2 = groups.agg(F.try_divide(between, between + within).alias("eta2")).scalar()
    return groups.select(
        F.col("value").cast("string").alias("value"), "n", "mean", "std", eta2.alias("eta2")
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Rows, columns, distinct rows, and rows beyond the first of each group of equal rows.

    Rows are grouped by a 256-bit digest, so that their width is not shuffled.
    """
    simple = [
        col(f.name) if family(f.dataType) == "complex" else present(df, f.name).alias(f.name) for f in df.schema.fields
    ]
    digest = F.sha2(F.to_json(F.struct(*simple)), 256).alias("_row")
    copies = df.select(digest).groupBy("_row").agg(F.count("*").alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def recommend_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Which share of a string column's non-null values reads as a number, timestamp or boolean.

    A type is recommended from a share of 0.99 on. Timestamps must start with a full date, and
    booleans must be spelled true or false, so that plain numbers count as neither.
    """
    columns = list(columns or columns_of(df, "string"))
    is_time = lambda c: col(c).rlike(TIMESTAMP_PATTERN) & F.try_to_timestamp(F.trim(col(c))).isNotNull()
    share = lambda test: lambda c: F.try_divide(F.count_if(test(c)), F.count(col(c)))
    stats = long_aggregate(
        df,
        columns,
        {
            "number_share": share(lambda c: col(c).rlike(NUMBER_PATTERN)),
            "timestamp_share": share(is_time),
            "boolean_share": share(lambda c: F.lower(F.trim(col(c))).isin("true", "false")),
        },
    )
    return stats.withColumn(
        "recommended",
        F.when(F.col("number_share") >= TYPE_SHARE, "number")
        .when(F.col("timestamp_share") >= TYPE_SHARE, "timestamp")
        .when(F.col("boolean_share") >= TYPE_SHARE, "boolean")
        .otherwise("string"),
    )


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """The full profile, one row per column.

    One pass computes counts and moments for every column; one the distinct values; one the
    quartiles; one counts the values outside the outlier bounds; one finds the modes of the string
    columns. The partial results have one row per column and are joined on the column name.
    """
    columns = df.columns
    numbers = numeric_columns(df)
    strings = columns_of(df, "string", "boolean")
    as_number = lambda agg: lambda c: (
        agg(number(df, c)) if c in numbers else F.lit(None).cast("double")
    )
    as_day = lambda agg: lambda c: (
        agg(F.to_date(col(c))).cast("string")
        if family(df.schema[c].dataType) == "datetime" else F.lit(None).cast("string")
    )
    stats = _with_distinct(
        df,
        columns,
        {
            "rows": lambda c: F.count("*"),
            "non_null": lambda c: F.count(present(df, c)),
            "mean_length": _text_length(df),
            "mean": as_number(F.avg),
            "std": as_number(F.stddev_samp),
            "min": as_number(F.min),
            "max": as_number(F.max),
            "skewness": as_number(F.skewness),
            "first_day": as_day(F.min),
            "last_day": as_day(F.max),
        },
        exact,
    )
    stats = stats.select(
        "column",
        "physical_type",
        _kind().alias("kind"),
        "rows",
        (F.col("rows") - F.col("non_null")).alias("missing"),
        F.try_divide(F.col("rows") - F.col("non_null"), F.col("rows")).alias("missing_share"),
        *[c for c in stats.columns if c not in ("column", "physical_type", "family", "rows", "non_null", "mean_length")],
    )
    null = F.lit(None)
    if numbers:
        q = quartiles(df, numbers, exact)
        spread = {c: None if v[0] is None else 1.5 * (v[2] - v[0]) for c, v in q.items()}
        bounds = {
            c: (None, None) if spread[c] is None else (v[0] - spread[c], v[2] + spread[c])
            for c, v in q.items()
        }
        kept = literal_rows(
            df.sparkSession,
            [(c, *v) for c, v in q.items()],
            "column string, q25 double, q50 double, q75 double",
        )
        outside = _outside(df, bounds).select("column", "low", "high")
        stats = stats.join(F.broadcast(kept), "column", "left")
        stats = stats.join(F.broadcast(outside), "column", "left")
    else:
        stats = stats.select(
            "*", *[null.cast("double").alias(c) for c in ("q25", "q50", "q75")],
            null.cast("long").alias("low"), null.cast("long").alias("high"),
        )
    if strings:
        modes = categorical_summary(df, strings).select("column", "mode", "mode_count")
        stats = stats.join(F.broadcast(modes), "column", "left")
    else:
        stats = stats.select("*", null.cast("string").alias("mode"), null.cast("long").alias("mode_count"))
    return stats


def profile_status(df: DataFrame, profiled: DataFrame, target: str | None = None) -> DataFrame:
    """The stage's status row: failed with a reason when the profile cannot be used downstream."""
    whole = profiled.agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.count("*").alias("columns_profiled")
    )
    missing_target = target is not None and target not in df.columns
    reason = (
        F.when(F.lit(missing_target), F.lit(f"target column {target} not found"))
        .when(F.col("rows") == 0, "dataset has no rows")
        .when(F.col("columns_profiled") < len(df.columns), "some columns were not profiled")
    )
    return whole.select(
        F.lit("EDAAgent").alias("stage"),
        F.when(reason.isNull(), "success").otherwise("failed").alias("pipeline_status"),
        reason.alias("pipeline_status_reason"),
        "rows",
        "columns_profiled",
    )
