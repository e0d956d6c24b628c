"""The paths taken for large or skewed data give the same answers as the simple ones."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window as W, functions as F

from tabulon.operators.features import category_index, term_counts, text_features
from tabulon.operators.lookup import fits_broadcast, lookup, lookup_counted
from tabulon.operators.metrics import ranking_metrics
from tabulon.operators.ordering import positions, previous_row, running_totals
from tabulon.operators.quantiles import quantile_table
from tabulon.operators.splits import hash_split, stratified_split


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds more than half of the rows."""
    return spark.range(3000).select(
        F.when(F.col("id") % 5 < 3, F.lit("hot")).when(F.col("id") % 50 == 4, None)
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 37).cast("string"))).alias("g"),
        F.col("id").alias("o"), (F.col("id") % 11).alias("v"),
    )


def test_running_totals_equal_window(skewed):
    w = W.partitionBy("g").orderBy("o").rowsBetween(W.unboundedPreceding, 0)
    want = skewed.withColumn("t", F.sum("v").over(w))
    assert rows(running_totals(skewed, ["g"], ["o"], {"t": "v"}, 7), "o") == rows(want, "o")


def test_positions_of_whole_table(skewed):
    got = positions(skewed, [], ["o"], slices=9).where("position <> o + 1")
    assert got.count() == 0


def test_previous_row_equals_lag(skewed):
    want = skewed.withColumn("p", F.lag("v").over(W.partitionBy("g").orderBy("o")))
    assert rows(previous_row(skewed, ["g"], ["o"], {"p": "v"}, 7), "o") == rows(want, "o")


def test_lookup_without_broadcast(spark, skewed):
    table = skewed.where("g is not null").groupBy("g").agg(F.count("*").alias("n"))
    small = lookup(skewed, table, ["g"])
    large = lookup(skewed, table, ["g"], limit=0)
    assert rows(small.select("o", "g", "n"), "o") == rows(large.select("o", "g", "n"), "o")
    plan = large._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan


def test_broadcast_size_is_measured(spark):
    wide = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert fits_broadcast(wide, 200_000) and not fits_broadcast(wide, 50_000)


@pytest.mark.parametrize("columns", [["x"], ["x", "y", "z"]])
def test_bracketed_quantiles_are_exact(spark, columns):
    df = spark.range(20_000).select(
        (F.hash("id") % 1000).cast("double").alias("x"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 7).alias("y"),
        F.when(F.col("id") % 10 == 0, F.lit(float("nan"))).when(F.col("id") % 7 > 0, F.exp(F.rand(3) * 20)).alias("z"),
    )
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r[:2]: r[2] for r in rows(quantile_table(df, columns, probs, accuracy=500), "column", "prob")}
    values = {c: F.when(~F.isnan(c), F.col(c)) for c in columns}
    exact = df.select(*[F.percentile(v, probs).alias(c) for c, v in values.items()]).first()
    want = {(c, p): exact[c][i] for c in columns for i, p in enumerate(probs)}
    assert got == pytest.approx(want)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.just(3.0)), min_size=1, max_size=150))
def test_bracketed_quantiles_property(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"x": pd.array(values, dtype="Float64")}).astype(object), "x double")
    got = quantile_table(df, ["x"], [0.1, 0.5, 0.9], accuracy=4).orderBy("prob").collect()
    want = df.agg(F.percentile("x", [0.1, 0.5, 0.9])).first()[0]
    assert [r["value"] for r in got] == (pytest.approx(want) if want else [None] * 3)


def test_category_index_beyond_broadcast(spark, skewed, monkeypatch):
    want = rows(category_index(skewed, "g"), "index")
    monkeypatch.setattr("tabulon.operators.features.fits_broadcast", lambda table: False)
    assert rows(category_index(skewed, "g"), "index") == want


def test_stratified_split_equals_ranking(skewed):
    out = stratified_split(skewed, "g", "o", {"train": 60, "test": 40})
    h = W.partitionBy("g").orderBy(F.md5(F.col("o").cast("string")))
    want = skewed.where("g is not null").select(
        "o",
        F.when(
            F.row_number().over(h) <= F.floor(F.count("*").over(W.partitionBy("g")) * 60 / 100), "train"
        ).otherwise("test").alias("split"),
    )
    assert rows(out.where("g is not null").select("o", "split"), "o") == rows(want, "o")
    assert out.where("g is null and split is not null").count() == 0
    assert out.count() == skewed.count()


def test_splits_are_stable_under_repartition(load):
    orders = load("orders").select("o_orderkey", "o_orderpriority")
    for split in (lambda d: hash_split(d, "o_orderkey"), lambda d: stratified_split(d, "o_orderpriority", "o_orderkey")):
        assert rows(split(orders), "o_orderkey") == rows(split(orders.repartition(7)), "o_orderkey")


def test_auc_with_ties_against_pairs(spark):
    data = spark.range(200).select((F.hash("id") % 2 == 0).cast("int").alias("label"), (F.col("id") % 9).cast("double").alias("score"))
    pairs = [(r["label"], r["score"]) for r in data.collect()]
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert ranking_metrics(data).first()["auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_text_features_against_brute_force(spark):
    docs = [(1, "a b  a\nC"), (2, "b c"), (3, ""), (4, None)]
    got = text_features(spark.createDataFrame(docs, "id long, t string"), "id", "t")
    assert {(r["id"], r["term"], r["tf"], r["df"]) for r in got.collect()} == {
        (1, "a", 2, 1), (1, "b", 1, 2), (1, "c", 1, 2), (2, "b", 1, 2), (2, "c", 1, 2),
    }


def test_text_features_shuffle_no_counted_rows(spark, load):
    """Rows are counted where they are; a key in several rows is summed; rare terms are joined as common ones are."""
    def plan(d):
        return term_counts(d, "id", "t")._jdf.queryExecution().executedPlan().toString()

    docs = spark.createDataFrame([(1, "a b  a\nC"), (2, "b c"), (3, ""), (4, None), (None, "x")], "id long, t string")
    assert "Exchange" not in plan(docs)
    twice = docs.union(docs.where("id = 1 or id is null")).union(spark.createDataFrame([(2, "C d")], docs.schema))
    got = {(r["id"], r["term"], r["tf"]) for r in term_counts(twice, "id", "t").collect()}
    assert got == {(1, "a", 4), (1, "b", 2), (1, "c", 2), (2, "b", 1), (2, "c", 2), (2, "d", 1), (None, "x", 2)}

    terms = term_counts(load("documents"), "doc_id", "text").persist()
    frequency = terms.groupBy("term").agg(F.count("*").alias("df")).persist()
    want = rows(terms.join(frequency, "term").select("doc_id", "term", "tf", "df"), "doc_id", "term", "tf", "df")
    for limit in (0, 2000, 1 << 26):
        out = lookup_counted(terms, frequency, "term", "df", limit)
        assert rows(out, "doc_id", "term", "tf", "df") == want
    some = lookup_counted(terms, frequency, "term", "df", 2000)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in some and "BroadcastHashJoin" in some
