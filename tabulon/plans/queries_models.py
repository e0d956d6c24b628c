"""Fitted pipelines, baselines, metrics and model comparison."""

from __future__ import annotations

import time

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from tabulon.functions.columns import literal_rows, union_all
from tabulon.operators import metrics as X
from tabulon.operators import models as M
from tabulon.operators import profile as P
from tabulon.operators import transforms as R
from tabulon.operators.baselines import baseline, group_baseline
from tabulon.operators.selection import FeatureSelector, FeatureSelectorModel
from tabulon.operators.splits import hash_split
from tabulon.plans.catalog import query, table
from tabulon.plans.queries_features import case_split, in_train, train_of
from tabulon.plans.queries_profile import profile_sql, rounded
from tabulon.session import scratch_path

ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


def step_sql(types: dict, source: str, target: str) -> str:
    p = profile_sql(types, source)
    gone = "(kind IN ('id', 'constant') OR missing_share > 0.6)"
    rule = lambda n, step, why, when: (
        f'SELECT "column", {n} AS ordinal, \'{step}\' AS step, {why} AS reason FROM p WHERE {when}'
    )
    parts = [
        rule(0, "drop", "CASE WHEN kind IN ('id', 'constant') THEN kind ELSE 'missing' END", gone),
        rule(1, "impute_median", "'missing values'", f"NOT {gone} AND kind = 'numeric' AND missing_share > 0"),
        rule(1, "impute_mode", "'missing values'", f"NOT {gone} AND kind = 'categorical' AND missing_share > 0"),
        rule(2, "clip", "'outliers'", f"NOT {gone} AND kind = 'numeric' AND (low + high) / (\"rows\" - missing)::DOUBLE > 0.01"),
        rule(3, "one_hot", "'few categories'", f"NOT {gone} AND kind = 'categorical' AND distinct_count <= 20"),
        rule(3, "frequency_encode", "'many categories'", f"NOT {gone} AND kind = 'categorical' AND distinct_count > 20"),
        rule(3, "date_parts", "'datetime'", f"NOT {gone} AND kind = 'datetime'"),
        rule(3, "text_size", "'text'", f"NOT {gone} AND kind = 'text'"),
        rule(4, "standardize", "'numeric'", f"NOT {gone} AND kind = 'numeric'"),
    ]
    return f"WITH p AS (SELECT * FROM ({p}) WHERE \"column\" <> '{target}') " + " UNION ALL ".join(parts)


EVENTS = {
    "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
    "value": "double", "props": "string",
}


@query("recommend_transforms", step_sql(ORDERS, "orders", "o_orderpriority"))
def recommend_transforms(spark, sf):
    return R.recommend(P.profile(table(spark, sf, "orders")), "o_orderpriority")


@query("recommend_transforms_outliers", step_sql(EVENTS, "events", "event_type"))
def recommend_transforms_outliers(spark, sf):
    return R.recommend(P.profile(table(spark, sf, "events")), "event_type")


@query(
    "fit_apply_transforms",
    f"""WITH t AS (SELECT * FROM part WHERE {in_train('p_partkey')}),
    q AS (SELECT avg(p_size) AS ms, stddev_samp(p_size) AS ss, avg(p_retailprice) AS mr, stddev_samp(p_retailprice) AS sr FROM t),
    n AS (SELECT p_name AS v, count(*) / (SELECT count(*) FROM t)::DOUBLE AS s FROM t GROUP BY 1),
    b AS (SELECT p_brand AS v, count(*) / (SELECT count(*) FROM t)::DOUBLE AS s FROM t GROUP BY 1)
    SELECT p_partkey, {case_split('p_partkey')} AS split, p_type, round((p_size - ms) / ss, 6) AS p_size,
    round((p_retailprice - mr) / sr, 6) AS p_retailprice, round(coalesce(n.s, 0), 6) AS p_name_freq,
    round(coalesce(b.s, 0), 6) AS p_brand_freq
    FROM part LEFT JOIN n ON n.v = p_name LEFT JOIN b ON b.v = p_brand, q""",
)
def fit_apply_transforms(spark, sf):
    part = hash_split(table(spark, sf, "part"), "p_partkey")
    plan = literal_rows(
        spark,
        [
            ("p_name", 3, "frequency_encode"), ("p_brand", 3, "frequency_encode"),
            ("p_size", 4, "standardize"), ("p_retailprice", 4, "standardize"),
        ],
        "column string, ordinal int, step string",
    )
    model = R.fit_transforms(part.where("split = 'train'"), plan, scratch_path(spark, "tables"))
    return rounded(model.transform(part))


@query(
    "saved_transforms",
    f"""WITH p AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders WHERE {in_train('o_orderkey')})
    SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, round((o_totalprice - m) / s, 6) AS o_totalprice,
    year(o_orderdate)::INTEGER AS o_orderdate_year FROM orders, p""",
)
def saved_transforms(spark, sf):
    orders = table(spark, sf, "orders")
    plan = literal_rows(
        spark, [("o_totalprice", 4, "standardize"), ("o_orderdate", 3, "date_parts")], "column string, ordinal int, step string"
    )
    model = R.fit_transforms(train_of(orders, "o_orderkey"), plan, scratch_path(spark, "tables"))
    path = scratch_path(spark, "saved")
    M.save_pipeline(model, path)
    parts = [f"o_orderdate_{p}" for p in ("month", "day", "weekday", "weekend")]
    return rounded(M.score(orders, path).drop(*parts))


@query(
    "feature_report",
    """SELECT 'FeatureEngineeringAgent' AS stage, 'failed' AS pipeline_status, 'not written: transformers' AS pipeline_status_reason,
    'o_totalprice' AS selected, string_agg(c, ',') AS dropped, FALSE AS has_transformers
    FROM (SELECT 'o_orderkey' AS c FROM orders HAVING count(DISTINCT o_orderkey) = count(*))""",
)
def feature_report(spark, sf):
    orders = table(spark, sf, "orders")
    plan = R.recommend(P.profile(orders))
    out = scratch_path(spark, "processed")
    orders.write.parquet(out)
    rep = R.feature_report(plan, ["o_totalprice"], {"dataset": out, "transformers": out + "-absent"})
    return rep.select(
        "stage", "pipeline_status", "pipeline_status_reason",
        F.array_join("selected_features", ",").alias("selected"), F.array_join("dropped_features", ",").alias("dropped"),
        F.col("transformer_path").isNotNull().alias("has_transformers"),
    )


SESSIONS = """(SELECT o_orderkey AS session_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Regression' WHEN '2-HIGH' THEN 'classification' WHEN '3-MEDIUM' THEN '' END AS task_type,
    CASE o_orderstatus WHEN 'F' THEN 'full_pipeline' WHEN 'O' THEN 'eda' ELSE 'clustering' END AS task_intent,
    CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'p_retailprice' WHEN '5-LOW' THEN 'p_type' END AS target_column FROM orders)"""


@query(
    "detect_task",
    f"""WITH k AS (SELECT 'p_retailprice' AS c, CASE WHEN count(DISTINCT p_retailprice) <= 1 THEN 'constant' ELSE 'numeric' END AS kind FROM part
    UNION ALL SELECT 'p_type', CASE WHEN count(DISTINCT p_type) <= 1 THEN 'constant' ELSE 'categorical' END FROM part)
    SELECT session_id, CASE WHEN lower(task_type) IN ('classification', 'regression', 'clustering') THEN lower(task_type)
    WHEN lower(task_intent) IN ('classification', 'regression', 'clustering') THEN lower(task_intent)
    WHEN coalesce(target_column, '') = '' THEN 'clustering' WHEN kind = 'categorical' THEN 'classification'
    WHEN kind = 'numeric' THEN 'regression' ELSE 'unknown' END AS task
    FROM {SESSIONS} LEFT JOIN k ON c = target_column""",
)
def detect_task(spark, sf):
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    sessions = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.when(prio == "1-URGENT", "Regression").when(prio == "2-HIGH", "classification").when(prio == "3-MEDIUM", "").alias("task_type"),
        F.when(status == "F", "full_pipeline").when(status == "O", "eda").otherwise("clustering").alias("task_intent"),
        F.when(prio == "4-NOT SPECIFIED", "p_retailprice").when(prio == "5-LOW", "p_type").alias("target_column"),
    )
    return M.detect_task(sessions, P.column_kinds(table(spark, sf, "part")))


@query(
    "prepare_target",
    """WITH d AS (SELECT quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
    SELECT CAST(quality AS DOUBLE) AS label, count(*) AS "rows", 2 AS features FROM d GROUP BY 1""",
)
def prepare_target(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    model = M.prepare(docs, "quality", ["n_chars", "doc_id"], classes=True)
    out = M.prepared(model, docs, "quality")
    return out.groupBy("label", F.size(vector_to_array("features")).alias("features")).agg(F.count("*").alias("rows"))


@query(
    "baseline_majority",
    f"""WITH c AS (SELECT o_orderstatus AS v, count(*) AS n FROM orders WHERE {in_train('o_orderkey')} GROUP BY 1)
    SELECT o_orderkey, o_orderstatus, (SELECT arg_min(v, (-n, v)) FROM c) AS prediction FROM orders""",
)
def baseline_majority(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return baseline(train_of(o, "o_orderkey"), o, "o_orderstatus", "classification")


@query(
    "baseline_mean",
    f"""SELECT o_orderkey, round((SELECT avg(o_totalprice) FROM orders WHERE {in_train('o_orderkey')}), 4) AS prediction FROM orders""",
)
def baseline_mean(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(baseline(train_of(o, "o_orderkey"), o, "o_totalprice", "regression").select("o_orderkey", "prediction"), 4)


GROUP_MEAN = f"""t AS (SELECT * FROM part WHERE {in_train('p_partkey')}),
    g AS (SELECT p_brand, avg(p_retailprice) AS m FROM t GROUP BY 1),
    s AS (SELECT p_partkey, p_retailprice AS y, coalesce(m, (SELECT avg(p_retailprice) FROM t)) AS p
          FROM part LEFT JOIN g USING (p_brand))"""


@query("group_baseline_mean", f"WITH {GROUP_MEAN} SELECT p_partkey, round(p, 6) AS prediction FROM s")
def group_baseline_mean(spark, sf):
    p = table(spark, sf, "part")
    out = group_baseline(train_of(p, "p_partkey"), p, "p_brand", "p_retailprice", "regression")
    return rounded(out.select("p_partkey", "prediction"))


@query(
    "group_baseline_majority",
    f"""WITH c AS (SELECT o_custkey, o_orderstatus AS v, count(*) AS n FROM orders WHERE {in_train('o_orderkey')} GROUP BY 1, 2),
    g AS (SELECT o_custkey, arg_min(v, (-n, v)) AS p FROM c GROUP BY 1),
    a AS (SELECT arg_min(v, (-n, v)) AS p FROM (SELECT v, sum(n) AS n FROM c GROUP BY 1))
    SELECT o_orderkey, coalesce(g.p, a.p) AS prediction FROM orders LEFT JOIN g USING (o_custkey), a""",
)
def group_baseline_majority(spark, sf):
    o = table(spark, sf, "orders")
    return group_baseline(train_of(o, "o_orderkey"), o, "o_custkey", "o_orderstatus", "classification").select(
        "o_orderkey", "prediction"
    )


def quality_predictions(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction")
    )


@query(
    "confusion_matrix",
    'SELECT quality AS label, 1 - toxic AS prediction, count(*) AS "count" FROM labels GROUP BY 1, 2',
)
def confusion_matrix(spark, sf):
    return X.confusion(quality_predictions(spark, sf))


PER_CLASS = """p AS (SELECT quality AS y, 1 - toxic AS p FROM labels), k AS (SELECT DISTINCT y AS c FROM p UNION SELECT DISTINCT p FROM p),
    m AS (SELECT c, (SELECT count(*) FROM p WHERE y = c) AS support, (SELECT count(*) FROM p WHERE p.p = c) AS predicted,
    (SELECT count(*) FROM p WHERE y = c AND p.p = c) AS hits FROM k),
    r AS (SELECT c, support, coalesce(hits / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall,
    coalesce(2.0::DOUBLE * hits / (predicted + support), 0) AS f1, hits FROM m)"""


@query(
    "per_class_metrics",
    f"""WITH {PER_CLASS} SELECT c AS "class", support, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1, 6) AS f1, hits FROM r""",
)
def per_class_metrics(spark, sf):
    return rounded(X.per_class_metrics(quality_predictions(spark, sf)))


@query(
    "classification_metrics",
    f"""WITH {PER_CLASS} SELECT CAST(sum(support) AS BIGINT) AS "rows", round(sum(hits) / sum(support)::DOUBLE, 6) AS accuracy,
    {', '.join(f'round(avg({m}), 6) AS macro_{m}' for m in ('precision', 'recall', 'f1'))},
    {', '.join(f'round(sum({m} * support) / sum(support)::DOUBLE, 6) AS weighted_{m}' for m in ('precision', 'recall', 'f1'))} FROM r""",
)
def classification_metrics(spark, sf):
    return rounded(X.classification_metrics(quality_predictions(spark, sf)))


@query(
    "ranking_metrics",
    """WITH e AS (SELECT CAST(event_type = 'purchase' AS INTEGER) AS y, value AS s, least(greatest(value / (value + 200), 1e-15), 1 - 1e-15) AS p FROM events),
    r AS (SELECT y, s, p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS mid FROM e),
    n AS (SELECT count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM e)
    SELECT any_value(pos) AS positives, any_value(neg) AS negatives,
    round((sum(mid) FILTER (WHERE y = 1) - any_value(pos) * (any_value(pos) + 1) / 2.0::DOUBLE) / (any_value(pos)::DOUBLE * any_value(neg)), 8) AS auc,
    round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM r, n""",
)
def ranking_metrics(spark, sf):
    pred = table(spark, sf, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("label"), F.col("value").alias("score"),
        (F.col("value") / (F.col("value") + 200)).alias("p"),
    )
    out = X.ranking_metrics(pred, probability="p")
    return out.withColumns({"auc": F.round("auc", 8), "log_loss": F.round("log_loss", 6)})


REGRESSION = """count(*) AS "rows", round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
    round(1 - avg((p - y) * (p - y)) / var_pop(y), 6) AS r2, round(avg(abs((p - y) / nullif(y, 0))), 6) AS mape, round(avg(p - y), 6) AS bias"""


@query("regression_metrics", f"WITH {GROUP_MEAN} SELECT {REGRESSION} FROM s")
def regression_metrics(spark, sf):
    p = table(spark, sf, "part")
    out = group_baseline(train_of(p, "p_partkey"), p, "p_brand", "p_retailprice", "regression")
    return rounded(X.regression_metrics(out, "p_retailprice"))


@query(
    "cluster_metrics",
    """WITH x AS (SELECT label, pos, CAST(embedding[pos] AS DOUBLE) AS v FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)),
    d AS (SELECT label, pos, count(*) AS n, var_pop(v) * count(*) AS s FROM x GROUP BY 1, 2)
    SELECT label AS cluster, max(n) AS size, round(sum(s), 5) AS sse FROM d GROUP BY 1""",
)
def cluster_metrics(spark, sf):
    return rounded(X.cluster_metrics(table(spark, sf, "embeddings"), "embedding", "label"), 5)


@query(
    "leaderboard",
    f"""WITH {GROUP_MEAN}, c AS (SELECT p_retailprice AS y, (SELECT avg(p_retailprice) FROM t) AS p FROM part),
    m AS (SELECT 'group mean' AS model, sqrt(avg((p - y) * (p - y))) AS value FROM s
    UNION ALL SELECT 'train mean', sqrt(avg((p - y) * (p - y))) FROM c)
    SELECT 'regression' AS task, model, 'rmse' AS metric, round(value, 6) AS value,
    CAST(row_number() OVER (ORDER BY value, model) AS INTEGER) AS rank, row_number() OVER (ORDER BY value, model) = 1 AS is_best FROM m""",
)
def leaderboard(spark, sf):
    p = table(spark, sf, "part")
    train = train_of(p, "p_partkey")
    frames = [
        X.regression_metrics(pred, "p_retailprice").select(
            F.lit("regression").alias("task"), F.lit(name).alias("model"), F.lit("rmse").alias("metric"), F.col("rmse").alias("value")
        )
        for name, pred in (
            ("group mean", group_baseline(train, p, "p_brand", "p_retailprice", "regression")),
            ("train mean", baseline(train, p, "p_retailprice", "regression")),
        )
    ]
    return rounded(X.leaderboard(frames[0].unionByName(frames[1])))


@query(
    "least_squares",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
    round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""",
)
def least_squares(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    data = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(d)
    m = LinearRegression(solver="normal").fit(data)
    scored = m.transform(data)
    return X.regression_metrics(scored).select(
        F.round(F.lit(float(m.coefficients[0])), 3).alias("slope"),
        F.round(F.lit(float(m.intercept)), 2).alias("intercept"), F.round("r2", 6).alias("r2"),
    )


def cores(spark) -> int:
    """The given tables are single files with one row group, that is, one partition."""
    return spark.sparkContext.defaultParallelism


def splits_of(spark, sf, name, key, target, features, classes):
    d = hash_split(table(spark, sf, name).select(key, target, *features) if target else table(spark, sf, name).select(key, *features), key)
    model = M.prepare(d.where("split = 'train'"), target, features, classes)
    ready = M.prepared(model, d, target)
    return ready.where("split = 'train'"), ready.where("split <> 'train'")


def events_data(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "user_id", "value", F.hour("ts").alias("hour"), (F.col("event_type") == "purchase").cast("int").alias("bought")
    )
    d = hash_split(e, "event_id")
    ready = M.prepared(M.prepare(d, "bought", ["user_id", "value", "hour"], True), d, "bought")
    return ready.where("split = 'train'"), ready.where("split <> 'train'")


def outcomes_sql(task: str, models: str, rows: str) -> str:
    """What must hold for each candidate: it succeeds and its metric lies in the metric's range."""
    names = ", ".join(f"('{m}')" for m in sorted(models.split()))
    return f"""SELECT '{task}' AS task, model, '{M.METRIC[task]}' AS metric, TRUE AS is_ranked, TRUE AS in_range,
        ({rows}) AS scored FROM (VALUES {names}) AS t(model)"""


def outcomes(results, task, valid, low, high):
    """The leaderboard without its values, with the number of rows the candidates were compared on."""
    ranked = M.compare(results, task)
    scored = valid.agg(F.count("*").alias("scored")).scalar()
    return ranked.select(
        "task", "model", "metric", F.col("rank").isNotNull().alias("is_ranked"), F.col("value").between(low, high).alias("in_range"),
        F.coalesce(scored, F.lit(0)).alias("scored"),
    )


VALID = "SELECT count(*) FROM {0} WHERE NOT ({1})"
TREES = "decision_tree random_forest"


@query(
    "classification_models",
    outcomes_sql(
        "classification", f"logistic_regression {TREES} naive_bayes gradient_boosted_trees linear_svc",
        VALID.format("events", in_train("event_id")),
    ),
)
def classification_models(spark, sf):
    train, valid = events_data(spark, sf)
    results = M.train_all(train, valid, M.candidates("classification", train), "classification", cores(spark))[1]
    return outcomes(results, "classification", valid, 0.0, 1.0)


@query(
    "classification_models_many_classes",
    outcomes_sql(
        "classification", f"logistic_regression {TREES} naive_bayes", VALID.format("orders", in_train("o_orderkey"))
    ),
)
def classification_models_many_classes(spark, sf):
    train, valid = splits_of(spark, sf, "orders", "o_orderkey", "o_orderpriority", ["o_totalprice", "o_custkey"], True)
    results = M.train_all(train, valid, M.candidates("classification", train), "classification", cores(spark))[1]
    return outcomes(results, "classification", valid, 0.0, 1.0)


@query(
    "regression_models",
    outcomes_sql(
        "regression", f"linear_regression ridge lasso {TREES} gradient_boosted_trees generalized_linear",
        VALID.format("lineitem", in_train("l_orderkey")),
    ),
)
def regression_models(spark, sf):
    train, valid = splits_of(spark, sf, "lineitem", "l_orderkey", "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], False)
    results = M.train_all(train, valid, M.regression_models(), "regression", cores(spark))[1]
    # No candidate may be much worse than the constant prediction.
    constant = valid.agg(F.stddev_pop("label")).first()[0]
    return outcomes(results, "regression", valid, 0.0, 1.5 * constant)


@query(
    "clustering_models",
    outcomes_sql(
        "clustering", "kmeans_2 kmeans_3 bisecting_kmeans_2 bisecting_kmeans_3 gaussian_mixture_2 gaussian_mixture_3",
        VALID.format("customer", in_train("c_custkey")),
    ),
)
def clustering_models(spark, sf):
    train, valid = splits_of(spark, sf, "customer", "c_custkey", None, ["c_acctbal", "c_nationkey"], False)
    results = M.train_all(train, valid, M.clustering_models((2, 3)), "clustering", cores(spark))[1]
    return outcomes(results, "clustering", valid, -1.0, 1.0)


TUNED = f"""SELECT count(*) AS "rows", TRUE AS in_range FROM events WHERE NOT ({in_train('event_id')})"""


def tuned_outcome(metrics):
    """The majority of the classes is more than half of the rows, so no tuned model should fall below."""
    return metrics.select("rows", F.col("accuracy").between(0.5, 1.0).alias("in_range"))


@query("tuned_holdout", TUNED)
def tuned_holdout(spark, sf):
    train, valid = events_data(spark, sf)
    lr = LogisticRegression(maxIter=10)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build()
    model = M.tuned("classification", lr, grid).fit(train)
    return tuned_outcome(X.classification_metrics(model.transform(valid)))


@query("tuned_cross_validation", TUNED)
def tuned_cross_validation(spark, sf):
    train, valid = events_data(spark, sf)
    lr = LogisticRegression(maxIter=10)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).build()
    model = M.tuned("classification", lr, grid, "cv").fit(M.fold_of(train, "event_id"))
    return tuned_outcome(X.classification_metrics(model.transform(valid)))


class Unfittable(LogisticRegression):
    """A candidate that always fails, to show that the others still report."""

    def _fit(self, dataset):
        raise RuntimeError("cannot be fitted")


@query(
    "fault_isolation",
    """SELECT 'broken' AS model, 'failed' AS status, 'cannot be fitted' AS reason
    UNION ALL SELECT 'logistic_regression', 'success', NULL""",
)
def fault_isolation(spark, sf):
    train, valid = events_data(spark, sf)
    models = {"broken": Unfittable(), "logistic_regression": LogisticRegression(maxIter=5)}
    return M.train_all(train, valid, models, "classification")[1].select("model", "status", "reason").distinct()


def fitted(spark, train, valid, task, name):
    """One of the built-in candidates, fitted and evaluated as in a run."""
    return M.train_all(train, valid, {name: M.candidates(task, train)[name]}, task)[0][name]


@query(
    "naive_bayes_fit",
    f"""WITH t AS (SELECT l_returnflag AS c, unnest(['l_quantity', 'l_linenumber', 'l_suppkey']) AS feature,
        unnest([l_quantity::DOUBLE, l_linenumber, l_suppkey]) AS x FROM lineitem WHERE {in_train('l_orderkey')}),
    s AS (SELECT c, feature, sum(x) AS s FROM t GROUP BY ALL),
    n AS (SELECT l_returnflag AS c, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS classes
        FROM lineitem WHERE {in_train('l_orderkey')} GROUP BY 1)
    SELECT c AS label, feature, round(ln((s + 1) / (sum(s) OVER (PARTITION BY c) + 3)), 6) AS log_share,
        round(ln((n + 1) / (total + classes)::DOUBLE), 6) AS log_prior FROM s JOIN n USING (c)""",
)
def naive_bayes_fit(spark, sf):
    """The probabilities the naive Bayes candidate learns, against counts."""
    features = ["l_quantity", "l_linenumber", "l_suppkey"]
    d = hash_split(table(spark, sf, "lineitem"), "l_orderkey")
    assembly = M.prepare(d, "l_returnflag", features, True)
    ready = M.prepared(assembly, d, "l_returnflag").select("label", "features", "split")
    model = fitted(spark, ready.where("split = 'train'"), ready.where("split <> 'train'"), "classification", "naive_bayes")
    shares, prior = model.theta.toArray(), model.pi.toArray()
    rows = [
        (c, f, float(shares[i, j]), float(prior[i]))
        for i, c in enumerate(assembly.stages[0].labels) for j, f in enumerate(features)
    ]
    return rounded(literal_rows(spark, rows, "label string, feature string, log_share double, log_prior double"))


#: A ridge with weight w on a standardised feature shrinks the slope of least squares by 1 + w / std(label).
LINE = f"""(SELECT regr_slope(l_extendedprice, l_quantity) / (1 + 0.1 / stddev_pop(l_extendedprice)) AS slope, avg(l_quantity) AS mx, avg(l_extendedprice) AS my
    FROM lineitem WHERE {in_train('l_orderkey')})"""


@query("ridge_fit", f"SELECT round(slope, 4) AS slope, round(my - slope * mx, 3) AS intercept FROM {LINE}")
def ridge_fit(spark, sf):
    train, valid = splits_of(spark, sf, "lineitem", "l_orderkey", "l_extendedprice", ["l_quantity"], False)
    model = fitted(spark, train, valid, "regression", "ridge")
    rows = [(round(float(model.coefficients[0]), 4), round(float(model.intercept), 3))]
    return literal_rows(spark, rows, "slope double, intercept double")


@query(
    "stump_fit",
    f"""WITH v AS (SELECT l_linenumber::DOUBLE AS x, count(*) AS n, sum(l_quantity) AS s FROM lineitem WHERE {in_train('l_orderkey')} GROUP BY 1),
    c AS (SELECT x, lead(x) OVER (ORDER BY x) AS y, sum(n) OVER (ORDER BY x) AS n, sum(s) OVER (ORDER BY x) AS s,
        sum(n) OVER () AS total, sum(s) OVER () AS whole FROM v),
    g AS (SELECT (x + y) / 2 AS threshold, s / n AS below, (whole - s) / (total - n) AS above, s * s / n + (whole - s) * (whole - s) / (total - n) AS gain
        FROM c WHERE y IS NOT NULL)
    SELECT threshold, round(below, 6) AS below, round(above, 6) AS above FROM g ORDER BY gain DESC LIMIT 1""",
)
def stump_fit(spark, sf):
    """The one cut of a tree of depth one, against the best of all cuts."""
    train, valid = splits_of(spark, sf, "lineitem", "l_orderkey", "l_quantity", ["l_linenumber"], False)
    tree = M.regression_models()["decision_tree"].copy()
    model = M.train_all(train, valid, {"stump": tree.setMaxDepth(1)}, "regression")[0]["stump"]
    node = model._call_java("rootNode")
    row = (node.split().threshold(), node.leftChild().prediction(), node.rightChild().prediction())
    return rounded(literal_rows(spark, [row], "threshold double, below double, above double"))


@query(
    "separated_clusters",
    f"""SELECT count(*) AS size, round(avg(c_nationkey % 3 * 1000 + c_acctbal / 10000), 4) AS center
    FROM customer WHERE {in_train('c_custkey')} GROUP BY c_nationkey % 3""",
)
def separated_clusters(spark, sf):
    """Three groups far apart: each clustering candidate has to find them; the answer is k-means', if they agree."""
    d = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 3 * 1000 + F.col("c_acctbal") / 10000).cast("double").alias("x"))
    d = hash_split(d, "c_custkey")
    ready = M.prepared(M.prepare(d, None, ["x"], False), d, None)
    train, valid = ready.where("split = 'train'"), ready.where("split <> 'train'")
    models, results = M.train_all(train, valid, {k: m for k, m in M.clustering_models((3,)).items() if k != "gaussian_mixture_3"}, "clustering")
    worst = results.where("metric = 'silhouette'").agg(F.min("value")).first()[0]
    found = models["kmeans_3"].transform(train).where(F.lit(worst > 0.99)).groupBy("prediction")
    return found.agg(F.count("*").alias("size"), F.round(F.avg("x"), 4).alias("center")).drop("prediction")


@query(
    "tuned_choice",
    """SELECT 0.0::DOUBLE AS weight, count(*) AS "rows", TRUE AS is_accurate FROM events WHERE value IS NOT NULL HAVING count(*) > 0""",
)
def tuned_choice(spark, sf):
    """A label that follows from a feature: tuning must choose the weight that does not flatten the model."""
    e = table(spark, sf, "events").where("value IS NOT NULL").select("event_id", "value", F.hour("ts").alias("hour"))
    e = e.withColumn("label", (F.col("hour") >= 12).cast("double"))
    ready = M.prepare(e, None, ["value", "hour"], False).transform(e)
    lr = LogisticRegression(maxIter=50)
    grid = ParamGridBuilder().addGrid(lr.regParam, [1000.0, 0.0]).build()
    best = M.train_all(ready, ready, {"tuned": M.tuned("classification", lr, grid)}, "classification")
    accuracy = best[1].where("metric = 'accuracy'").first()["value"]
    scored = best[0]["tuned"].transform(ready)
    return scored.agg(
        F.lit(float(best[0]["tuned"].getOrDefault("regParam"))).alias("weight"), F.count("*").alias("rows"),
        F.lit(accuracy > 0.97).alias("is_accurate"),
    )


@query(
    "telling_features",
    """SELECT model, 'hour' AS feature FROM (VALUES ('decision_tree'), ('random_forest'), ('gradient_boosted_trees'), ('logistic_regression')) AS t(model),
    (SELECT count(*) AS n FROM events) WHERE n > 0""",
)
def telling_features(spark, sf):
    """The feature a label follows from has most of the importance in every candidate that has one."""
    e = table(spark, sf, "events").select(
        "event_id", F.coalesce("value", F.lit(0.0)).alias("value"), F.hour("ts").alias("hour"), (F.col("event_id") % 7).alias("noise")
    ).withColumn("label", (F.col("hour") >= 12).cast("double"))
    features = ["value", "hour", "noise"]
    ready = M.prepare(e, None, features, False).transform(e)
    models = {k: m for k, m in M.classification_models(2, False).items() if k != "linear_svc"}
    found = []
    for name, model in M.train_all(ready, ready, models, "classification")[0].items():
        weights = M.importance(model, features, spark)
        top = weights.orderBy(F.desc("importance")).limit(1)
        found.append(top.select(F.lit(name).alias("model"), "feature"))
    return union_all(found)


class Endless(LogisticRegression):
    """A candidate whose fitting starts a Spark job that does not end."""

    def _fit(self, dataset):
        def wait(batches):
            for batch in batches:
                time.sleep(3600)
                yield batch

        dataset.select("label").mapInPandas(wait, "label double").count()


@query(
    "time_limited_candidates",
    """SELECT 'endless' AS model, 'failed' AS status, 'time limit of 3 s' AS reason UNION ALL SELECT 'broken', 'failed', 'cannot be fitted'
    UNION ALL SELECT 'logistic_regression', 'success', NULL""",
)
def time_limited_candidates(spark, sf):
    """A candidate that hangs is stopped and reported; the others are fitted meanwhile."""
    train, valid = events_data(spark, sf)
    models = {"endless": Endless(), "broken": Unfittable(), "logistic_regression": LogisticRegression(maxIter=5)}
    limits = {"endless": 3, "broken": 300, "logistic_regression": 300}
    return M.train_all(train, valid, models, "classification", limit=limits)[1].select("model", "status", "reason").distinct()


#: Columns of `lineitem` to choose from, with one that only varies outside the training rows.
CHOICE = {
    "a_quantity": "cast(l_quantity AS double)",
    "b_price": "l_extendedprice",
    "c_copy": "2 * l_extendedprice + l_tax",
    "d_late": "CASE WHEN l_linenumber > 0 AND {train} THEN 1.0 ELSE l_quantity END",
    "e_missing": "CASE WHEN NOT ({train}) THEN l_tax END",
    "f_tax": "l_tax",
}


@query(
    "fitted_selection",
    f"""WITH t AS (SELECT {', '.join(f"{v.format(train=in_train('l_orderkey'))} AS {k}" for k, v in CHOICE.items())}
        FROM lineitem WHERE {in_train('l_orderkey')}),
    p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM t" for a in CHOICE for b in CHOICE if a < b)}),
    v AS ({' UNION ALL '.join(f"""SELECT '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS kinds FROM t""" for c in CHOICE)}),
    w AS (SELECT "column", CASE WHEN n = 0 THEN 'missing' WHEN kinds = 1 THEN 'constant' END AS why FROM v),
    x AS (SELECT w."column", coalesce(why, 'duplicate of ' || (SELECT min(a) FROM p WHERE b = w."column" AND abs(r) > 0.95 AND NOT isnan(r))) AS reason FROM w)
    SELECT "column", reason IS NULL AS selected, reason FROM x""",
)
def fitted_selection(spark, sf):
    d = hash_split(table(spark, sf, "lineitem"), "l_orderkey").withColumn("in_train", F.col("split") == "train")
    d = d.selectExpr("split", *[f"{v.format(train='in_train')} AS {k}" for k, v in CHOICE.items()])
    path = scratch_path(spark, "selection")
    FeatureSelector(inputCols=list(CHOICE)).fit(d.where("split = 'train'")).write().save(path)
    return FeatureSelectorModel.load(path).report(spark)


@query(
    "cluster_silhouette",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    d AS (SELECT a.vec_id, a.label, b.label AS other, count(*) AS n, sum(power(list_distance(a.v, b.v), 2)) AS s FROM e a, e b GROUP BY ALL),
    p AS (SELECT vec_id, label, max(n) FILTER (other = label) AS n, max(s / nullif(n - 1, 0)) FILTER (other = label) AS a,
        min(s / n) FILTER (other <> label) AS b FROM d GROUP BY ALL)
    SELECT label AS cluster, count(*) AS size,
        round(avg(CASE WHEN n = 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
    FROM p GROUP BY label""",
)
def cluster_silhouette(spark, sf):
    return rounded(X.silhouette(table(spark, sf, "embeddings"), "embedding", "label"))


@query(
    "training_report",
    """SELECT 'ModelTrainingAgent' AS stage, 'success' AS pipeline_status, NULL::VARCHAR AS pipeline_status_reason,
    1::BIGINT AS trained, 1::BIGINT AS failed, '/models/best' AS model_path, 'logistic_regression' AS best_model,
    'user_id,value,hour' AS selected_features, '/data/processed' AS dataset_path, TRUE AS has_accuracy, 0.75::DOUBLE AS test_accuracy""",
)
def training_report(spark, sf):
    train, valid = events_data(spark, sf)
    models = {"broken": Unfittable(), "logistic_regression": LogisticRegression(maxIter=5)}
    rows = M.train_all(train, valid, models, "classification")[1]
    features = ["user_id", "value", "hour"]
    report = M.training_report(rows, "/models/best", "logistic_regression", features, "/data/processed", {"accuracy": 0.75})
    return report.select(
        "stage", "pipeline_status", "pipeline_status_reason", "trained", "failed", "model_path", "best_model",
        F.array_join("selected_features", ",").alias("selected_features"), "dataset_path",
        F.col("metrics")["accuracy"].between(0, 1).alias("has_accuracy"), F.col("test_metrics")["accuracy"].alias("test_accuracy"),
    )


@query(
    "batch_scoring",
    f"""WITH t AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i
        FROM orders WHERE {in_train('o_orderkey')})
    SELECT o_orderkey, round(i + s * o_custkey, 2) AS prediction FROM orders, t""",
)
def batch_scoring(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    stages = [
        VectorAssembler(inputCols=["o_custkey"], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LinearRegression(labelCol="o_totalprice", maxIter=5),
    ]
    path = scratch_path(spark, "model")
    M.save_pipeline(Pipeline(stages=stages).fit(train_of(d, "o_orderkey")), path)
    return M.score(d, path).select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@query(
    "feature_importance",
    "SELECT feature, 1.0::DOUBLE AS total, TRUE AS in_range FROM (VALUES ('user_id'), ('value'), ('hour')) AS t(feature)",
)
def feature_importance(spark, sf):
    train, _ = events_data(spark, sf)
    model = M.classification_models(2, False)["random_forest"].fit(train)
    found = M.importance(model, ["user_id", "value", "hour"], spark)
    total = found.agg(F.round(F.sum("importance"), 6).alias("total")).scalar()
    return found.select("feature", F.coalesce(total, F.lit(0.0)).alias("total"), F.col("importance").between(0, 1).alias("in_range"))
