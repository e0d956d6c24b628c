"""Candidate models, training with fault isolation, and comparison.

Models are Spark ML estimators over an assembled vector column; fitting is distributed by the
library. What is collected to the driver is one number per candidate and metric.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import (
    ClusteringEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, functions as F

from tabulon.functions.columns import col, family, literal_rows
from tabulon.operators.metrics import (
    classification_metrics,
    cluster_metrics,
    leaderboard,
    regression_metrics,
)
from tabulon.operators.side_by_side import side_by_side
from tabulon.operators.splits import hash_bucket

SEED = 42
RESULT = "task string, model string, status string, reason string, metric string, value double"
METRIC = {"classification": "accuracy", "regression": "rmse", "clustering": "silhouette"}
FOLDS = 3
#: Seconds a candidate may take, and how many are fitted at the same time.
TIME_LIMIT, PARALLEL = 300.0, 4
#: Values, in columns and vectors, that a partition of a kept table has, about: some tens of MB with what tree models add.
PART_VALUES = 2_000_000


def detect_task(sessions: DataFrame, target_kinds: DataFrame) -> DataFrame:
    """`session_id, task`: the stated task type, else the intent, else the target column's kind.

    `target_kinds` holds `column, physical_type, kind` of the profiled table: one row per column. A target is
    never an id: one that looks like it is a number to be estimated, or else a class.
    """
    known = ("classification", "regression", "clustering")
    stated = F.when(F.lower("task_type").isin(*known), F.lower("task_type"))
    intent = F.when(F.lower("task_intent").isin(*known), F.lower("task_intent"))
    by_kind = (
        F.when(F.col("target_column").isNull() | (F.col("target_column") == ""), "clustering")
        .when(F.col("kind").isin("categorical", "boolean"), "classification")
        .when(F.col("kind") == "numeric", "regression")
        .when(F.col("kind") == "id", F.when(F.col("physical_type") == "string", "classification").otherwise("regression"))
    )
    kinds = target_kinds.select(F.col("column").alias("target_column"), "physical_type", "kind")
    joined = sessions.join(F.broadcast(kinds), "target_column", "left")
    return joined.select("session_id", F.coalesce(stated, intent, by_kind, F.lit("unknown")).alias("task"))


def prepare(df: DataFrame, target: str | None, features: Sequence[str], classes: bool) -> PipelineModel:
    """Fitted assembly: `label` and `features`.

    Class targets are indexed, so that any values can be labels: texts with the most frequent first,
    numbers in the order of their texts. The index in the saved assembly turns predictions back.
    """
    stages = []
    if target is not None and classes and family(df.schema[target].dataType) != "boolean":
        order = "frequencyDesc" if family(df.schema[target].dataType) == "string" else "alphabetAsc"
        stages.append(StringIndexer(inputCol=target, outputCol="label", handleInvalid="skip", stringOrderType=order))
    stages.append(VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df)


def prepared(model: PipelineModel, df: DataFrame, target: str | None) -> DataFrame:
    """Rows with a target, with `label` and `features`."""
    if target is not None:
        df = df.where(col(target).isNotNull())
    out = model.transform(df)
    if target is not None and "label" not in out.columns:
        out = out.withColumn("label", col(target).cast("double"))
    return out


def classification_models(classes: int, non_negative: bool) -> dict[str, Estimator]:
    """Candidates that accept this many classes and these features."""
    out = {
        "logistic_regression": LogisticRegression(maxIter=20),
        "decision_tree": DecisionTreeClassifier(seed=SEED),
        "random_forest": RandomForestClassifier(numTrees=20, seed=SEED),
    }
    if non_negative:
        out["naive_bayes"] = NaiveBayes()
    if classes == 2:
        out["gradient_boosted_trees"] = GBTClassifier(maxIter=10, seed=SEED)
        out["linear_svc"] = LinearSVC(maxIter=20)
    return out


def regression_models() -> dict[str, Estimator]:
    return {
        "linear_regression": LinearRegression(),
        "ridge": LinearRegression(regParam=0.1, elasticNetParam=0.0),
        "lasso": LinearRegression(regParam=0.1, elasticNetParam=1.0),
        "decision_tree": DecisionTreeRegressor(seed=SEED),
        "random_forest": RandomForestRegressor(numTrees=20, seed=SEED),
        "gradient_boosted_trees": GBTRegressor(maxIter=10, seed=SEED),
        "generalized_linear": GeneralizedLinearRegression(family="gaussian"),
    }


def clustering_models(ks: Sequence[int] = (2, 3, 4)) -> dict[str, Estimator]:
    out: dict[str, Estimator] = {}
    for k in ks:
        out[f"kmeans_{k}"] = KMeans(k=k, seed=SEED)
        out[f"bisecting_kmeans_{k}"] = BisectingKMeans(k=k, seed=SEED)
        out[f"gaussian_mixture_{k}"] = GaussianMixture(k=k, seed=SEED, maxIter=20)
    return out


def candidates(task: str, train: DataFrame) -> dict[str, Estimator]:
    """The candidates for a task, gated by what the training data allows."""
    if task == "classification":
        low = F.array_min(vector_to_array("features"))
        row = train.agg(F.count_distinct("label").alias("classes"), F.min(low).alias("low")).first()
        return classification_models(row["classes"], row["low"] is not None and row["low"] >= 0)
    if task == "regression":
        return regression_models()
    if task == "clustering":
        return clustering_models()
    raise ValueError(f"unsupported task {task!r}")


def evaluate(task: str, scored: DataFrame) -> dict[str, float]:
    """Metrics of one candidate's predictions."""
    if task == "clustering":
        silhouette = ClusteringEvaluator().evaluate(scored)
        sse = cluster_metrics(scored).agg(F.sum("sse")).first()[0]
        return {"silhouette": silhouette, "sse": sse}
    metrics = classification_metrics if task == "classification" else regression_metrics
    row = metrics(scored).drop("rows").first()
    return {k: v for k, v in row.asDict().items() if v is not None}


def fold_of(df: DataFrame, key: str, folds: int = FOLDS) -> DataFrame:
    """Add `fold`, stable under repartitioning, for cross-validation."""
    return df.withColumn("fold", (hash_bucket(col(key), "fold") % folds).cast("int"))


def tuned(task: str, estimator: Estimator, grid: Sequence[dict], how: str = "holdout") -> Estimator:
    """The estimator with its parameter grid searched by hold-out or by cross-validation on `fold`."""
    evaluator = (
        MulticlassClassificationEvaluator(metricName="accuracy")
        if task == "classification" else RegressionEvaluator(metricName="rmse")
    )
    built = grid or ParamGridBuilder().build()
    if how == "cv":
        return CrossValidator(
            estimator=estimator, estimatorParamMaps=built, evaluator=evaluator,
            numFolds=FOLDS, foldCol="fold", parallelism=2,
        )
    return TrainValidationSplit(
        estimator=estimator, estimatorParamMaps=built, evaluator=evaluator, trainRatio=0.8, seed=SEED
    )


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """`df` dealt into `least` partitions, or into more when they would have more than `PART_VALUES` values each.

    Without `least` it stays as it is unless one of its partitions has more.
    """
    some = df.select("features").take(100) if "features" in df.columns else []
    width = len(df.columns) + sum(len(r["features"].values) for r in some) / max(len(some), 1)
    sizes = df.select(F.spark_partition_id().alias("part")).groupBy("part").count()
    rows, most = (n or 0 for n in sizes.agg(F.sum("count"), F.max("count")).first())
    if least is None and most * width <= PART_VALUES:
        return df
    return df.repartition(max(least or 1, math.ceil(rows * width / PART_VALUES)))


def train_all(
    train: DataFrame,
    valid: DataFrame,
    models: Mapping[str, Estimator],
    task: str,
    partitions: int | None = None,
    limit: float | Mapping[str, float] = TIME_LIMIT,
    parallel: int = PARALLEL,
) -> tuple[dict[str, Model], DataFrame]:
    """Fit and evaluate every candidate, several at once; a failing one becomes a row with its reason.

    A candidate that takes more than `limit` seconds (one number, or one per name) is stopped and fails for that
    reason, so one that hangs costs its limit and no more. Of a tuned candidate the best model counts.

    Returns the fitted models and `task, model, status, reason, metric, value`. Both inputs are
    kept for the repeated passes of iterative fitting and released afterwards. Give `partitions`
    when the input comes in fewer pieces than there are cores; a large input, or without `partitions` one in
    large pieces, gets more of them, so that what a task reads in each pass does not grow with it.
    """
    train, valid = spread(train, partitions).persist(), spread(valid, partitions).persist()

    def fit(estimator: Estimator) -> tuple[Model, dict[str, float]]:
        model = estimator.fit(train)
        model = getattr(model, "bestModel", model)
        return model, evaluate(task, model.transform(valid))

    try:
        jobs = {name: partial(fit, estimator) for name, estimator in models.items()}
        found = side_by_side(train.sparkSession, jobs, limit, parallel)
    finally:
        train.unpersist()
        valid.unpersist()
    fitted, rows = {}, []
    for name, result in found.items():
        if isinstance(result, Exception):
            rows.append((task, name, "failed", str(result).strip() or type(result).__name__, None, None))
        else:
            fitted[name], values = result
            rows += [(task, name, "success", None, metric, float(value)) for metric, value in values.items()]
    return fitted, literal_rows(train.sparkSession, rows, RESULT)


def compare(results: DataFrame, task: str) -> DataFrame:
    """The leaderboard on the task's main metric; failed candidates are listed last."""
    main = F.lit(METRIC[task])
    kept = results.where((F.col("metric") == main) | (F.col("status") == "failed"))
    return leaderboard(kept.withColumn("metric", main))


def importance(model: Model, features: Sequence[str], spark) -> DataFrame:
    """`feature, importance`: tree importances, or coefficients; empty for other models."""
    model = getattr(model, "bestModel", model)
    weights = getattr(model, "featureImportances", None)
    if weights is None:
        matrix = getattr(model, "coefficientMatrix", None)
        if matrix is not None:
            weights = abs(matrix.toArray()).max(axis=0)
        else:
            weights = getattr(model, "coefficients", None)
    if weights is None:
        return spark.createDataFrame([], "feature string, importance double")
    values = weights.toArray() if hasattr(weights, "toArray") else weights
    return literal_rows(
        spark, [(f, float(w)) for f, w in zip(features, values)], "feature string, importance double"
    )


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(df: DataFrame, path: str) -> DataFrame:
    """Apply a saved pipeline to new rows."""
    return load_pipeline(path).transform(df)


def training_report(
    results: DataFrame,
    best_path: str | None = None,
    best: str | None = None,
    features: Sequence[str] = (),
    dataset_path: str | None = None,
    test: Mapping[str, float] | None = None,
) -> DataFrame:
    """The stage's status row: failed only when no candidate could be trained.

    `metrics` are those of the best model on the validation rows, `test_metrics` on rows that neither
    training nor the choice of the model has seen.
    """
    ok = F.count_distinct(F.when(F.col("status") == "success", F.col("model")))
    bad = F.count_distinct(F.when(F.col("status") == "failed", F.col("model")))
    chosen = F.when(F.col("model") == best, F.struct("metric", "value")) if best else F.lit(None).cast("struct<metric:string,value:double>")
    metrics = F.map_from_entries(F.array_sort(F.collect_list(chosen))).alias("metrics")
    whole = results.agg(ok.alias("trained"), bad.alias("failed"), metrics)
    failed = F.col("trained") == 0
    return whole.select(
        F.lit("ModelTrainingAgent").alias("stage"),
        F.when(failed, "failed").otherwise("success").alias("pipeline_status"),
        F.when(failed, "no model could be trained").alias("pipeline_status_reason"),
        "trained",
        "failed",
        F.lit(best_path).cast("string").alias("model_path"),
        F.lit(best).cast("string").alias("best_model"),
        "metrics",
        F.create_map(*[F.lit(x) for kv in sorted((test or {}).items()) for x in kv]).cast("map<string,double>").alias("test_metrics"),
        F.array(*[F.lit(f) for f in features]).cast("array<string>").alias("selected_features"),
        F.lit(dataset_path).cast("string").alias("dataset_path"),
    )
