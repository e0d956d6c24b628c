"""Feature preparation and split queries. `train` is always the hashed train split."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import features as E
from tabulon.operators import profile as P
from tabulon.operators.splits import hash_bucket, hash_split, stratified_split
from tabulon.plans.catalog import query, table
from tabulon.plans.queries_profile import LINEITEM, kind_sql, rounded

BUCKET = "(('0x' || substr(md5(CAST({k} AS VARCHAR)), 1, 8))::BIGINT % 100)"


def train_of(df, key):
    return df.where(hash_bucket(F.col(key)) < 70)


def in_train(key: str) -> str:
    return BUCKET.format(k=key) + " < 70"


def case_split(key: str) -> str:
    b = BUCKET.format(k=key)
    return f"CASE WHEN {b} < 70 THEN 'train' WHEN {b} < 85 THEN 'validation' ELSE 'test' END"


@query("hash_split", f"SELECT o_orderkey, {case_split('o_orderkey')} AS split FROM orders")
def hashed(spark, sf):
    return hash_split(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "split")


@query(
    "stratified_split",
    """SELECT o_orderkey, o_orderpriority, CASE WHEN r <= n * 70 // 100 THEN 'train'
    WHEN r <= n * 85 // 100 THEN 'validation' ELSE 'test' END AS split FROM (
    SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
      ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)""",
)
def stratified(spark, sf):
    out = stratified_split(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")
    return out.select("o_orderkey", "o_orderpriority", "split")


def labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


LABELLED = "(SELECT doc_id, n_chars, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query(
    "impute_mean",
    f"""WITH d AS {LABELLED} SELECT doc_id,
    round(coalesce(quality, (SELECT avg(quality) FROM d WHERE {in_train('doc_id')})), 6) AS quality,
    CAST(quality IS NULL AS INTEGER) AS quality_missing FROM d""",
)
def impute_mean(spark, sf):
    d = labelled(spark, sf)
    return rounded(E.impute(train_of(d, "doc_id"), d, "quality", "mean").select("doc_id", "quality", "quality_missing"))


@query(
    "impute_median",
    f"""WITH d AS (SELECT doc_id, CASE WHEN quality IS NOT NULL THEN n_chars END AS size FROM {LABELLED})
    SELECT doc_id, round(coalesce(size, (SELECT quantile_cont(size, 0.5) FROM d WHERE {in_train('doc_id')})), 6) AS size,
    CAST(size IS NULL AS INTEGER) AS size_missing FROM d""",
)
def impute_median(spark, sf):
    d = labelled(spark, sf).select("doc_id", F.when(F.col("quality").isNotNull(), F.col("n_chars")).alias("size"))
    return rounded(E.impute(train_of(d, "doc_id"), d, "size", "median"))


@query(
    "impute_mode",
    f"""WITH d AS {LABELLED}, c AS (SELECT toxic AS v, count(*) AS n FROM d WHERE toxic IS NOT NULL AND {in_train('doc_id')} GROUP BY 1)
    SELECT doc_id, coalesce(toxic, (SELECT arg_min(v, (-n, v)) FROM c)) AS toxic,
    CAST(toxic IS NULL AS INTEGER) AS toxic_missing FROM d""",
)
def impute_mode(spark, sf):
    d = labelled(spark, sf)
    return E.impute(train_of(d, "doc_id"), d, "toxic", "mode").select("doc_id", "toxic", "toxic_missing")


@query(
    "impute_constant",
    f"""SELECT doc_id, coalesce(quality, -1) AS quality, CAST(quality IS NULL AS INTEGER) AS quality_missing FROM {LABELLED}""",
)
def impute_constant(spark, sf):
    d = labelled(spark, sf)
    return E.impute(d, d, "quality", "constant", -1).select("doc_id", "quality", "quality_missing")


@query(
    "index_encode",
    f"""WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE {in_train('o_orderkey')} GROUP BY 1),
    i AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS i FROM c)
    SELECT o_orderkey, coalesce(i, (SELECT count(*) FROM c)) AS o_orderpriority_index
    FROM orders LEFT JOIN i ON v = o_orderpriority""",
)
def index_encode(spark, sf):
    o = table(spark, sf, "orders")
    return E.index_encode(train_of(o, "o_orderkey"), o, "o_orderpriority").select("o_orderkey", "o_orderpriority_index")


@query(
    "index_encode_wide",
    f"""WITH c AS (SELECT l_partkey AS v, count(*) AS n FROM lineitem WHERE {in_train('l_orderkey')} GROUP BY 1),
    i AS (SELECT v, row_number() OVER (ORDER BY n DESC, v) - 1 AS i FROM c)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(i, (SELECT count(*) FROM c)) AS l_partkey_index
    FROM lineitem LEFT JOIN i ON v = l_partkey""",
)
def index_encode_wide(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return E.index_encode(train_of(d, "l_orderkey"), d, "l_partkey")


@query(
    "one_hot",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"CAST(l_returnflag = '{v}' AS INTEGER) AS \"l_returnflag_{v}\"" for v in "ANR"
    ) + " FROM lineitem",
)
def one_hot(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return E.one_hot(train_of(d, "l_orderkey"), d, "l_returnflag").drop("l_returnflag")


@query(
    "frequency_encode",
    f"""WITH t AS (SELECT * FROM part WHERE {in_train('p_partkey')}),
    c AS (SELECT p_brand AS v, count(*) / (SELECT count(*) FROM t)::DOUBLE AS s FROM t GROUP BY 1)
    SELECT p_partkey, round(coalesce(s, 0), 6) AS p_brand_freq FROM part LEFT JOIN c ON v = p_brand""",
)
def frequency_encode(spark, sf):
    p = table(spark, sf, "part")
    return rounded(E.frequency_encode(train_of(p, "p_partkey"), p, "p_brand").select("p_partkey", "p_brand_freq"))


@query(
    "target_encode",
    f"""WITH t AS (SELECT * FROM orders WHERE {in_train('o_orderkey')}), m AS (SELECT avg(o_totalprice) AS m FROM t),
    c AS (SELECT o_custkey AS v, (sum(o_totalprice) + 10 * any_value(m)) / (count(*) + 10) AS s FROM t, m GROUP BY 1)
    SELECT o_orderkey, round(coalesce(s, m), 4) AS o_custkey_target FROM orders LEFT JOIN c ON v = o_custkey, m""",
)
def target_encode(spark, sf):
    o = table(spark, sf, "orders")
    out = E.target_encode(train_of(o, "o_orderkey"), o, "o_custkey", "o_totalprice", 10.0)
    return rounded(out.select("o_orderkey", "o_custkey_target"), 4)


@query(
    "standardize",
    f"""WITH p AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem WHERE {in_train('l_orderkey')})
    SELECT l_orderkey, l_linenumber, l_quantity, round((l_quantity - m) / s, 6) AS l_quantity_z FROM lineitem, p""",
)
def standardize(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(E.standardize(train_of(d, "l_orderkey"), d, ["l_quantity"]))


@query(
    "minmax_scale",
    f"""WITH p AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part WHERE {in_train('p_partkey')})
    SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 6) AS p_retailprice_01 FROM part, p""",
)
def minmax_scale(spark, sf):
    p = table(spark, sf, "part")
    return rounded(E.minmax_scale(train_of(p, "p_partkey"), p, ["p_retailprice"]).select("p_partkey", "p_retailprice_01"))


@query(
    "maxabs_scale",
    f"""WITH p AS (SELECT max(abs(c_acctbal)) AS top FROM customer WHERE {in_train('c_custkey')})
    SELECT c_custkey, round(c_acctbal / top, 6) AS c_acctbal_abs FROM customer, p""",
)
def maxabs_scale(spark, sf):
    c = table(spark, sf, "customer")
    return rounded(E.maxabs_scale(train_of(c, "c_custkey"), c, ["c_acctbal"]).select("c_custkey", "c_acctbal_abs"))


@query(
    "robust_scale",
    f"""WITH p AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3
    FROM events WHERE {in_train('event_id')})
    SELECT event_id, round((value - q2) / (q3 - q1), 6) AS value_robust FROM events, p""",
)
def robust_scale(spark, sf):
    e = table(spark, sf, "events")
    return rounded(E.robust_scale(train_of(e, "event_id"), e, ["value"]).select("event_id", "value_robust"))


@query(
    "l2_normalize",
    """SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(embedding[pos] AS DOUBLE) / n, 5) AS value FROM (
    SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS pos,
    sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)""",
)
def l2_normalize(spark, sf):
    e = E.l2_normalize(table(spark, sf, "embeddings"), "embedding")
    return rounded(e.select("vec_id", F.posexplode("embedding").alias("pos", "value")), 5)


OUTLIER_BOUNDS = f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events
    WHERE {in_train('event_id')}), b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) """


@query("clip_outliers", OUTLIER_BOUNDS + "SELECT event_id, round(greatest(least(value, hi), lo), 6) AS value FROM events, b")
def clip_outliers(spark, sf):
    e = table(spark, sf, "events")
    return rounded(E.clip_outliers(train_of(e, "event_id"), e, "value").select("event_id", "value"))


@query("filter_outliers", OUTLIER_BOUNDS + "SELECT event_id, value FROM events, b WHERE value BETWEEN lo AND hi")
def filter_outliers(spark, sf):
    e = table(spark, sf, "events")
    return E.clip_outliers(train_of(e, "event_id"), e, "value", "filter").select("event_id", "value")


@query("flag_outliers", OUTLIER_BOUNDS + "SELECT event_id, CAST(value < lo OR value > hi AS INTEGER) AS value_outlier FROM events, b")
def flag_outliers(spark, sf):
    e = table(spark, sf, "events")
    return E.clip_outliers(train_of(e, "event_id"), e, "value", "flag").select("event_id", "value_outlier")


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
    CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(dayofweek(o_orderdate) AS INTEGER) AS o_orderdate_weekday,
    CAST(dayofweek(o_orderdate) IN (0, 6) AS INTEGER) AS o_orderdate_weekend FROM orders""",
)
def date_parts(spark, sf):
    return E.date_parts(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "derive",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(1 + l_extendedprice), 6) AS l_extendedprice_log1p,
    l_quantity * l_quantity AS l_quantity_square, round(l_extendedprice / nullif(l_tax, 0), 3) AS l_extendedprice_l_tax_ratio,
    round(l_extendedprice * l_discount, 5) AS l_extendedprice_l_discount_product,
    round(l_discount - l_tax, 4) AS l_discount_l_tax_difference FROM lineitem""",
)
def derive(spark, sf):
    d = table(spark, sf, "lineitem")
    out = E.derive(
        d,
        [
            ("log1p", "l_extendedprice"), ("square", "l_quantity"), ("ratio", "l_extendedprice", "l_tax"),
            ("product", "l_extendedprice", "l_discount"), ("difference", "l_discount", "l_tax"),
        ],
    )
    r = lambda c, d: F.round(c, d).alias(c)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("l_extendedprice_log1p", 6), "l_quantity_square",
        r("l_extendedprice_l_tax_ratio", 3), r("l_extendedprice_l_discount_product", 5), r("l_discount_l_tax_difference", 4),
    )


@query(
    "bin_equal_width",
    f"""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE {in_train('o_orderkey')})
    SELECT o_orderkey, CAST(greatest(least(floor((o_totalprice - lo) / ((hi - lo) / 8)), 7), 0) AS INTEGER) AS o_totalprice_bin FROM orders, s""",
)
def bin_equal_width(spark, sf):
    o = table(spark, sf, "orders")
    return E.bin_column(train_of(o, "o_orderkey"), o, "o_totalprice", 8).select("o_orderkey", "o_totalprice_bin")


@query(
    "bin_quantile",
    "WITH e AS (SELECT " + ", ".join(f"quantile_cont(o_totalprice, {i / 5}) AS e{i}" for i in range(1, 5))
    + f" FROM orders WHERE {in_train('o_orderkey')}) SELECT o_orderkey, CAST("
    + " + ".join(f"CAST(o_totalprice >= e{i} AS INTEGER)" for i in range(1, 5))
    + " AS INTEGER) AS o_totalprice_bin FROM orders, e",
)
def bin_quantile(spark, sf):
    o = table(spark, sf, "orders")
    return E.bin_column(train_of(o, "o_orderkey"), o, "o_totalprice", 5, "quantile").select("o_orderkey", "o_totalprice_bin")


SELECTABLE = {**LINEITEM, "price_copy": "double"}
WITH_COPY = "(SELECT *, l_extendedprice * 1.1 AS price_copy FROM lineitem)"


@query(
    "select_features",
    f"""WITH d AS {WITH_COPY}, k AS ({kind_sql(SELECTABLE, 'd')}),
    r AS (SELECT abs(corr(l_extendedprice, price_copy)) AS r FROM d)
    SELECT "column", NOT (kind IN ('constant', 'id') OR ("column" = 'price_copy' AND r > 0.95)) AS selected,
    CASE WHEN kind IN ('constant', 'id') THEN kind WHEN "column" = 'price_copy' AND r > 0.95
    THEN 'duplicate of l_extendedprice' END AS reason FROM k, r""",
)
def select_features(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("price_copy", F.col("l_extendedprice") * 1.1)
    kinds_ = P.column_kinds(d).join(F.broadcast(P.missing(d).select("column", "missing_share")), "column")
    return E.select_features(kinds_, P.correlations(d))


RANKED = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query(
    "rank_features",
    "WITH s AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", power(corr({c}, l_extendedprice), 2) AS score FROM lineitem" for c in RANKED
    ) + " UNION ALL " + " UNION ALL ".join(
        f"""SELECT '{c}', (SELECT sum(n * (m - g) * (m - g)) / (sum(n) * max(v)) FROM
        (SELECT count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY {c}),
        (SELECT avg(l_extendedprice) AS g, var_pop(l_extendedprice) AS v FROM lineitem))"""
        for c in ("l_returnflag", "l_linestatus")
    ) + """) SELECT * FROM (SELECT "column", round(score, 8) AS score, CAST(row_number() OVER (ORDER BY score DESC, "column") AS INTEGER) AS rank FROM s)
    WHERE rank <= 4""",
)
def rank_features(spark, sf):
    d = table(spark, sf, "lineitem")
    return rounded(E.rank_features(d, "l_extendedprice", 4, [*RANKED, "l_returnflag", "l_linestatus"]), 8)


@query(
    "text_features",
    """WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY 1, 2),
    f AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
    SELECT doc_id, term, tf, df, round(tf * ln(((SELECT count(text) FROM documents) + 1) / (df + 1)::DOUBLE), 6) AS tfidf
    FROM c JOIN f USING (term)""",
)
def text_features(spark, sf):
    return rounded(E.text_features(table(spark, sf, "documents"), "doc_id", "text"))


@query(
    "input_guard",
    """SELECT 'unsupported type' AS problem, 'embedding' AS "column", FALSE AS fatal FROM embeddings HAVING count(*) > 0
    UNION ALL SELECT 'target column not found', 'species', TRUE FROM embeddings HAVING count(*) > 0
    UNION ALL SELECT 'dataset is empty', NULL, TRUE FROM embeddings WHERE label < 0 HAVING count(*) = 0""",
)
def input_guard(spark, sf):
    e = table(spark, sf, "embeddings")
    return E.guard(e.where("label < 0"), "species")
