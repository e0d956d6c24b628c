"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.columns import union_all
from tabulon.operators import profile as P, sketches
from tabulon.operators.quantiles import quantile_table
from tabulon.plans.catalog import query, table
from tabulon.session import scratch_path

LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
PART = {
    "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
    "p_size": "int", "p_retailprice": "double",
}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def each(columns, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


def rounded(df, digits: int = 6, *keep: str):
    """Doubles rounded, so that the order of float additions does not show."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name)
            if f.dataType.simpleString() == "double" and f.name not in keep else f.name
            for f in df.schema.fields
        ]
    )


def kind_sql(types: dict, source: str) -> str:
    parts = []
    for c, t in types.items():
        integral, text = t in ("int", "bigint"), t == "string"
        length = f"avg(length({c}))" if text else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", '{t}' AS physical_type, {integral} AS is_int, {text} AS is_str, "
            f"{t.startswith('timestamp')} AS is_time, count({c}) AS non_null, count(DISTINCT {c}) AS d, "
            f"{length} AS len FROM {source}"
        )
    return (
        'SELECT "column", physical_type, CASE WHEN d <= 1 THEN \'constant\' WHEN is_time THEN \'datetime\' '
        "WHEN (is_int OR is_str) AND d = non_null THEN 'id' WHEN is_str AND len > 50 THEN 'text' "
        "WHEN is_str THEN 'categorical' WHEN is_int AND d <= 20 THEN 'categorical' ELSE 'numeric' END AS kind, "
        f"non_null, d AS distinct_count FROM ({' UNION ALL '.join(parts)})"
    )


@query("column_kinds", kind_sql(PART, "part"))
def column_kinds(spark, sf):
    return P.column_kinds(table(spark, sf, "part"))


@query("column_kinds_text", kind_sql({"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}, "documents"))
def column_kinds_text(spark, sf):
    return P.column_kinds(table(spark, sf, "documents"))


@query(
    "missing_values",
    each(
        ["doc_id", "n_chars", "lang", "quality", "toxic"],
        """SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS missing,
        round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS missing_share
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    ),
)
def missing_values(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    return rounded(P.missing(docs.join(table(spark, sf, "labels"), "doc_id", "left")))


@query(
    "numeric_summary",
    each(
        MEASURES,
        """SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 5) AS mean,
        round(stddev_samp({c}), 5) AS std, min({c}) AS "min", round(quantile_cont({c}, 0.25), 5) AS q25,
        round(quantile_cont({c}, 0.5), 5) AS q50, round(quantile_cont({c}, 0.75), 5) AS q75,
        max({c}) AS "max" FROM lineitem""",
    ),
)
def numeric_summary(spark, sf):
    return rounded(P.numeric_summary(table(spark, sf, "lineitem"), MEASURES), 5)


def agreement(approx, exact, allowed: dict[str, float]):
    """`column` and, for each measure, whether its approximate value is within the allowed share of the exact one."""
    left = approx.select("column", *[F.col(c).cast("double").alias(f"_{c}") for c in allowed])
    near = [
        F.coalesce(F.abs(F.col(f"_{c}") - F.col(c)) <= e * F.greatest(F.abs(F.col(c).cast("double")), F.lit(1e-9)), F.col(c).isNull()).alias(c)
        for c, e in allowed.items()
    ]
    return exact.join(left, "column").select("column", *near)


APPROXIMATE = {"mean": 1e-9, "q25": 0.02, "q50": 0.02, "q75": 0.02}


@query(
    "numeric_summary_approx",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {', '.join(f'TRUE AS {m}' for m in APPROXIMATE)}" for c in MEASURES),
)
def numeric_summary_approx(spark, sf):
    """The sketched quartiles lie within 2 % of the exact ones."""
    lineitem = table(spark, sf, "lineitem")
    return agreement(P.numeric_summary(lineitem, MEASURES, exact=False), P.numeric_summary(lineitem, MEASURES), APPROXIMATE)


@query(
    "shape_moments",
    """WITH m AS (SELECT count(value) AS n, avg(value) AS mean, var_pop(value) AS v FROM events)
    SELECT 'value' AS "column", round(m.v, 4) AS variance,
    round(avg(power(value - m.mean, 3)) / power(m.v, 1.5), 6) AS skewness,
    round(avg(power(value - m.mean, 4)) / power(m.v, 2) - 3, 6) AS kurtosis
    FROM events, m GROUP BY m.v""",
)
def shape_moments(spark, sf):
    m = P.moments(table(spark, sf, "events"), ["value"])
    return m.select(
        "column", F.round("variance", 4).alias("variance"),
        F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"),
    )


def mode_sql(columns, source: str) -> str:
    return each(
        columns,
        f"""SELECT '{{c}}' AS "column", count(*) AS distinct_count, arg_min(v, (-n, v)) AS mode,
        max(n) AS mode_count, round(max(n) / sum(n)::DOUBLE, 6) AS mode_share
        FROM (SELECT {{c}} AS v, count(*) AS n FROM {source} WHERE {{c}} IS NOT NULL GROUP BY 1)""",
    )


@query("categorical_summary", mode_sql(["o_orderstatus", "o_orderpriority"], "orders"))
def categorical_summary(spark, sf):
    return rounded(P.categorical_summary(table(spark, sf, "orders")))


@query(
    "datetime_summary",
    """SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d') AS first_day,
    strftime(max(o_orderdate), '%Y-%m-%d') AS last_day,
    count(DISTINCT CAST(o_orderdate AS DATE)) AS distinct_days,
    CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS BIGINT) AS span_days FROM orders""",
)
def datetime_summary(spark, sf):
    out = P.datetime_summary(table(spark, sf, "orders"))
    return out.select(
        "column", F.col("first_day").cast("string").alias("first_day"),
        F.col("last_day").cast("string").alias("last_day"), "distinct_days", "span_days",
    )


@query(
    "text_summary",
    """SELECT 'text' AS "column", count(text) AS n,
    count(*) FILTER (WHERE NOT regexp_matches(text, '[^ \\t\\n\\r\\f]')) AS empty,
    min(length(text)) AS min_length, round(avg(length(text)), 6) AS mean_length, max(length(text)) AS max_length,
    CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda t: t <> ''))) AS BIGINT) AS tokens
    FROM documents""",
)
def text_summary(spark, sf):
    return rounded(P.text_summary(table(spark, sf, "documents"), ["text"]))


@query(
    "cardinality",
    each(
        ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
        """SELECT '{c}' AS "column", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count,
        round(count(DISTINCT {c}) / count({c})::DOUBLE, 6) AS distinct_share FROM customer""",
    ),
)
def cardinality(spark, sf):
    return rounded(P.cardinality(table(spark, sf, "customer")))


@query(
    "cardinality_approx",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", TRUE AS distinct_count" for c in "c_custkey c_name c_nationkey c_acctbal c_mktsegment".split()
    ),
)
def cardinality_approx(spark, sf):
    """The sketched distinct counts lie within 15 % (three standard errors of 5 %) of the exact ones."""
    customer = table(spark, sf, "customer")
    return agreement(P.cardinality(customer, exact=False), P.cardinality(customer), {"distinct_count": 0.15})


@query(
    "value_counts",
    """SELECT event_type AS value, count(*) AS "count" FROM events WHERE event_type IS NOT NULL
    GROUP BY 1 ORDER BY 2 DESC, 1""",
)
def value_counts(spark, sf):
    return P.value_counts(table(spark, sf, "events"), "event_type")


@query(
    "most_frequent",
    'SELECT l_partkey AS value, count(*) AS "count" FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100',
)
def most_frequent(spark, sf):
    return P.most_frequent(table(spark, sf, "lineitem"), "l_partkey", 100)


@query("rarest", 'SELECT l_partkey AS value, count(*) AS "count" FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 5')
def rarest(spark, sf):
    return P.rarest(table(spark, sf, "lineitem"), "l_partkey", 5)


@query("n_unique", "SELECT count(DISTINCT l_partkey) AS n_unique FROM lineitem")
def n_unique(spark, sf):
    return P.n_unique(table(spark, sf, "lineitem"), "l_partkey")


BOUNDS = """ SELECT '{c}' AS "column", count({c}) AS n, round(max(b.lo), 6) AS lower, round(max(b.hi), 6) AS upper,
    count(*) FILTER (WHERE {c} < b.lo) AS low, count(*) FILTER (WHERE {c} > b.hi) AS high FROM events, b"""


@query(
    "iqr_outliers",
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), "
    "b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)" + BOUNDS.format(c="value"),
)
def iqr_outliers(spark, sf):
    return rounded(P.iqr_outliers(table(spark, sf, "events"), ["value"]))


@query(
    "zscore_outliers",
    "WITH b AS (SELECT avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM events)"
    + BOUNDS.format(c="value"),
)
def zscore_outliers(spark, sf):
    return rounded(P.zscore_outliers(table(spark, sf, "events"), ["value"]))


@query(
    "histogram",
    """WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    p AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, hi FROM events, s)
    SELECT bin, round(lo + bin * ((hi - lo) / 20), 6) AS bin_from, round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS bin_to,
    count(*) AS "count" FROM p GROUP BY bin, lo, hi""",
)
def histogram(spark, sf):
    return rounded(P.histogram(table(spark, sf, "events"), "value", 20))


DECILES = [i / 10 for i in range(1, 10)]
DECILE_SQL = " UNION ALL ".join(
    f"SELECT '{{c}}' AS \"column\", CAST({p} AS DOUBLE) AS prob, round(quantile_cont({{c}}, {p}), 6) AS value FROM {{t}}"
    for p in DECILES
)


@query("quantile_table", DECILE_SQL.format(c="o_totalprice", t="orders"))
def deciles(spark, sf):
    return rounded(P.quantiles(table(spark, sf, "orders"), ["o_totalprice"], DECILES), 6, "prob")


@query("quantile_table_ranked", DECILE_SQL.format(c="l_extendedprice", t="lineitem"))
def deciles_ranked(spark, sf):
    out = quantile_table(table(spark, sf, "lineitem"), ["l_extendedprice"], DECILES)
    return rounded(out, 6, "prob")


@query(
    "target_balance",
    """WITH c AS (SELECT quality AS v, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1),
    w AS (SELECT sum(n)::DOUBLE AS t, max(n) / min(n)::DOUBLE AS r FROM c)
    SELECT CAST(v AS VARCHAR) AS value, n AS "count", round(n / t, 6) AS share, round(r, 6) AS imbalance_ratio,
    round((SELECT -sum(n / t * ln(n / t)) FROM c, w), 6) AS entropy FROM c, w""",
)
def target_balance(spark, sf):
    return rounded(P.target_balance(table(spark, sf, "labels"), "quality"))


CORRELATED = ["l_linenumber", *MEASURES]


@query(
    "correlations",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
        for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]
    ),
)
def correlations(spark, sf):
    return rounded(P.correlations(table(spark, sf, "lineitem"), CORRELATED))


RANKS = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in ("p_size", "p_retailprice", "p_partkey")
)


@query(
    "rank_correlations",
    f"WITH r AS (SELECT {RANKS} FROM part) " + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM r"
        for a, b in (("p_size", "p_retailprice"), ("p_size", "p_partkey"), ("p_retailprice", "p_partkey"))
    ),
)
def rank_correlations(spark, sf):
    return rounded(P.wide_correlations(table(spark, sf, "part"), ["p_size", "p_retailprice", "p_partkey"]))


SKETCHED = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]


@query(
    "stored_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS missing, round(avg({c}), 5) AS mean,
        round(stddev_samp({c}), 5) AS std, CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max",
        TRUE AS distinct_near, TRUE AS quartiles_near FROM (SELECT * REPLACE (CASE WHEN l_orderkey % 9 > 0 THEN l_discount END AS l_discount) FROM lineitem)"""
        for c in SKETCHED
    ),
)
def stored_profile(spark, sf):
    """States of three deliveries, one of them written twice, against the whole table.

    Distinct counts have to be within 5 % of the exact ones, and the share of values up to a quartile within 2 % (and
    the values equal to it) of what it should be.
    """
    d = table(spark, sf, "lineitem").select("l_orderkey", *SKETCHED)
    d = d.withColumn("l_discount", F.when(F.col("l_orderkey") % 9 > 0, F.col("l_discount")))
    path = scratch_path(spark, "states")
    for part in (0, 1, 2, 1):
        sketches.write_part(d.where(F.col("l_orderkey") % 3 == part), path, str(part), SKETCHED)
    found = sketches.stored_profile(spark, path)
    quartile = {r["column"]: r for r in found.collect()}  # one row per column
    checks = []
    for c in SKETCHED:
        q = quartile[c]
        x = F.col(c).cast("double")
        near = [
            F.avg((x < q[f"q{n}"]).cast("double")).between(-1, n / 100 + 0.02) & F.avg((x <= q[f"q{n}"]).cast("double")).between(n / 100 - 0.02, 2)
            for n in (25, 50, 75)
        ]
        few = F.abs(F.count_distinct(x) - q["distinct_count"]) <= 0.05 * q["distinct_count"]
        checks.append(d.agg(F.lit(c).alias("column"), few.alias("distinct_near"), (near[0] & near[1] & near[2]).alias("quartiles_near")))
    out = found.join(union_all(checks), "column")
    return rounded(out.select("column", "rows", "missing", "mean", "std", "min", "max", "distinct_near", "quartiles_near"), 5)


#: Forty columns made from `lineitem`, each with gaps of its own.
MANY = [
    f"CASE WHEN (l_orderkey + {k}) % 11 > 0 THEN (l_partkey * {k + 1}) % {97 + k} + l_quantity * {k % 3} END" for k in range(40)
]


@query(
    "correlations_wide",
    f"WITH d AS (SELECT {', '.join(f'{sql} AS c{k:02}' for k, sql in enumerate(MANY))} FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT 'c{i:02}' AS a, 'c{j:02}' AS b, round(corr(c{i:02}, c{j:02}), 6) AS r FROM d"
        for i in range(len(MANY)) for j in range(i + 1, len(MANY))
    ),
)
def correlations_wide(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr(*[f"{sql} AS c{k:02}" for k, sql in enumerate(MANY)])
    return rounded(P.correlations(d))


#: A column with one value on half of all rows, one with few values, and one with gaps.
TIED = {
    "half": "CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_extendedprice END",
    "few": "l_discount",
    "gaps": "CASE WHEN l_orderkey % 7 > 0 THEN l_extendedprice + l_linenumber END",
}


@query(
    "rank_correlations_tied",
    f"""WITH d AS (SELECT * FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in TIED.items())} FROM lineitem) WHERE gaps IS NOT NULL),
    r AS (SELECT {', '.join(f"rank() OVER (ORDER BY {k}) + (count(*) OVER (PARTITION BY {k}) - 1) / 2.0::DOUBLE AS {k}" for k in TIED)} FROM d) """
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM r" for a, b in (("half", "few"), ("half", "gaps"), ("few", "gaps"))
    ),
)
def rank_correlations_tied(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in TIED.items()])
    return rounded(P.wide_correlations(d, list(TIED)))


def chi_square_sql(source: str, a: str, b: str) -> str:
    """The test by its definition; the tail as the finite sum that holds for an even number of degrees."""
    return f"""SELECT '{a}' AS a, '{b}' AS b, n::BIGINT AS n, round(chi2, 5) AS chi2, degrees,
        round((SELECT sum(exp(-chi2 / 2 + j * ln(chi2 / 2) - lgamma(j + 1))) FROM range(0, degrees // 2) AS s(j)), 9) AS p_value
        FROM (SELECT any_value(total) AS n, sum((o - e) * (o - e) / e) AS chi2,
            ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::BIGINT AS degrees FROM (
            SELECT a, b, r * c / total::DOUBLE AS e, total, coalesce((SELECT count(*) FROM {source} WHERE {a} = a AND {b} = b), 0) AS o
            FROM (SELECT {a} AS a, count(*) AS r FROM {source} GROUP BY 1), (SELECT {b} AS b, count(*) AS c FROM {source} GROUP BY 1),
                (SELECT count(*) AS total FROM {source})))"""


TESTED = [("lineitem", "l_returnflag", "l_linestatus"), ("orders", "o_orderstatus", "o_orderpriority"), ("customer", "c_mktsegment", "c_nationkey")]


@query("chi_square_test", " UNION ALL ".join(f"SELECT * FROM ({chi_square_sql(*t)})" for t in TESTED))
def chi_square_test(spark, sf):
    frames = [
        P.chi_square_test(table(spark, sf, source), a, b).select(
            F.lit(a).alias("a"), F.lit(b).alias("b"), "n", F.round("chi2", 5).alias("chi2"), "degrees", F.round("p_value", 9).alias("p_value")
        )
        for source, a, b in TESTED
    ]
    return union_all(frames)


@query(
    "cramers_v",
    """WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
    r AS (SELECT a, sum(o) AS r FROM o GROUP BY 1), c AS (SELECT b, sum(o) AS c FROM o GROUP BY 1),
    n AS (SELECT sum(o) AS n FROM o),
    g AS (SELECT coalesce(o.o, 0) AS o, r.r * c.c / n.n::DOUBLE AS e FROM r CROSS JOIN c CROSS JOIN n
          LEFT JOIN o ON o.a = r.a AND o.b = c.b),
    x AS (SELECT sum((o - e) * (o - e) / e) AS chi2 FROM g)
    SELECT CAST(n AS BIGINT) AS n, (SELECT count(*) FROM r) AS levels_a, (SELECT count(*) FROM c) AS levels_b,
    round(chi2, 5) AS chi2,
    round(sqrt(chi2 / n / (least((SELECT count(*) FROM r), (SELECT count(*) FROM c)) - 1)), 6) AS cramers_v FROM x, n""",
)
def cramers_v(spark, sf):
    out = P.cramers_v(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    return rounded(rounded(out, 5, "cramers_v"))


@query(
    "target_numeric",
    """WITH g AS (SELECT avg(p_retailprice) AS m, var_pop(p_retailprice) AS v FROM part),
    c AS (SELECT p_brand AS value, count(*) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS std
          FROM part GROUP BY 1),
    e AS (SELECT sum(n * (mean - m) * (mean - m)) / (sum(n) * max(v)) AS eta2 FROM c, g)
    SELECT value, n, round(mean, 6) AS mean, round(std, 6) AS std, round(eta2, 6) AS eta2 FROM c, e""",
)
def target_numeric(spark, sf):
    return rounded(P.target_numeric(table(spark, sf, "part"), "p_retailprice", "p_brand"))


@query(
    "table_shape",
    """WITH e AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE user_id % 3 = 0),
    g AS (SELECT event_id, ts, user_id, event_type, value, props, count(*) AS n FROM e GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS "rows", 6 AS columns, count(*) AS distinct_rows,
    CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g""",
)
def table_shape(spark, sf):
    events = table(spark, sf, "events")
    return P.table_shape(events.unionByName(events.where("user_id % 3 = 0")))


@query(
    "recommend_types",
    """SELECT 'o_orderkey' AS "column", 1.0::DOUBLE AS number_share, 0.0::DOUBLE AS timestamp_share, 0.0::DOUBLE AS boolean_share,
    'number' AS recommended FROM orders HAVING bool_and(TRY_CAST(CAST(o_orderkey AS VARCHAR) AS DOUBLE) IS NOT NULL)
    UNION ALL SELECT 'o_totalprice', avg(CASE WHEN TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END),
    0.0::DOUBLE, 0.0::DOUBLE, 'number' FROM orders
    UNION ALL SELECT 'o_orderdate', 0.0::DOUBLE, avg(CASE WHEN TRY_CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) IS NULL THEN 0.0 ELSE 1.0 END),
    0.0::DOUBLE, 'timestamp' FROM orders
    UNION ALL SELECT 'is_open', 0.0::DOUBLE, 0.0::DOUBLE, avg(CASE WHEN CAST(o_orderstatus = 'O' AS VARCHAR) IN ('true', 'false') THEN 1.0 ELSE 0.0 END),
    'boolean' FROM orders
    UNION ALL SELECT 'o_orderpriority', avg(CASE WHEN TRY_CAST(o_orderpriority AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END), 0.0::DOUBLE, 0.0::DOUBLE,
    'string' FROM orders""",
)
def recommend_types(spark, sf):
    o = table(spark, sf, "orders")
    return P.recommend_types(
        o.select(
            F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"),
            F.col("o_orderdate").cast("string"), (F.col("o_orderstatus") == "O").cast("string").alias("is_open"),
            "o_orderpriority",
        )
    )


def profile_sql(types: dict, source: str) -> str:
    parts = []
    for c, t in types.items():
        num = t in ("int", "bigint", "double")
        text, time = t == "string", t.startswith("timestamp")
        d = lambda e: e if num else "CAST(NULL AS DOUBLE)"
        s = lambda e: e if time else "CAST(NULL AS VARCHAR)"
        length = f"avg(length({c}))" if text else "CAST(NULL AS DOUBLE)"
        outside = (
            f"""(SELECT {{f}} FROM {source}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}))"""
            if num else "CAST(NULL AS BIGINT)"
        )
        mode = f"""(SELECT {{f}} FROM (SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1))"""
        parts.append(
            f"""SELECT '{c}' AS "column", '{t}' AS physical_type,
            {t in ('int', 'bigint')} AS is_int, {text} AS is_str, {time} AS is_time, {length} AS len,
            count(*) AS "rows", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_count,
            {d(f"round(avg({c}), 5)")} AS mean, {d(f"round(stddev_samp({c}), 5)")} AS std,
            {d(f"CAST(min({c}) AS DOUBLE)")} AS "min", {d(f"CAST(max({c}) AS DOUBLE)")} AS "max",
            {d(f"round(CASE WHEN var_pop({c}) > 0 THEN (avg(CAST({c} AS DOUBLE) * {c} * {c}) - 3 * avg({c}) * avg(CAST({c} AS DOUBLE) * {c}) + 2 * power(avg({c}), 3)) / power(var_pop({c}), 1.5) END, 4)")} AS skewness,
            {s(f"strftime(min({c}), '%Y-%m-%d')")} AS first_day, {s(f"strftime(max({c}), '%Y-%m-%d')")} AS last_day,
            {d(f"round(quantile_cont({c}, 0.25), 5)")} AS q25, {d(f"round(quantile_cont({c}, 0.5), 5)")} AS q50,
            {d(f"round(quantile_cont({c}, 0.75), 5)")} AS q75,
            {outside.format(f=f"count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1))")} AS low,
            {outside.format(f=f"count(*) FILTER (WHERE {c} > q3 + 1.5 * (q3 - q1))")} AS high,
            {mode.format(f="arg_min(v, (-n, v))") if text else "CAST(NULL AS VARCHAR)"} AS mode,
            {mode.format(f="max(n)") if text else "CAST(NULL AS BIGINT)"} AS mode_count
            FROM {source}"""
        )
    return (
        """SELECT "column", physical_type, CASE WHEN distinct_count <= 1 THEN 'constant' WHEN is_time THEN 'datetime'
        WHEN (is_int OR is_str) AND distinct_count = non_null THEN 'id' WHEN is_str AND len > 50 THEN 'text'
        WHEN is_str THEN 'categorical' WHEN is_int AND distinct_count <= 20 THEN 'categorical' ELSE 'numeric' END AS kind,
        "rows", "rows" - non_null AS missing, round(("rows" - non_null) / "rows"::DOUBLE, 5) AS missing_share, distinct_count,
        mean, std, "min", "max", skewness, first_day, last_day, q25, q50, q75, low, high, mode, mode_count FROM ("""
        + " UNION ALL ".join(parts) + ")"
    )


@query("profile", profile_sql(LINEITEM, "lineitem"))
def profile(spark, sf):
    out = P.profile(table(spark, sf, "lineitem"))
    return rounded(out.withColumn("skewness", F.round("skewness", 4)), 5)


@query(
    "profile_approx",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", TRUE AS missing, TRUE AS distinct_count" for c in LINEITEM),
)
def profile_approx(spark, sf):
    lineitem = table(spark, sf, "lineitem")
    return agreement(P.profile(lineitem, exact=False), P.profile(lineitem), {"missing": 0.0, "distinct_count": 0.15})


@query(
    "profile_status",
    """SELECT 'EDAAgent' AS stage, 'success' AS pipeline_status, CAST(NULL AS VARCHAR) AS pipeline_status_reason,
    count(*) AS "rows", CAST(5 AS BIGINT) AS columns_profiled FROM customer""",
)
def profile_status(spark, sf):
    df = table(spark, sf, "customer")
    return P.profile_status(df, P.profile(df), "c_mktsegment")
