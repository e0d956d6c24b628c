"""Evaluation metrics as plain aggregations over a table of predictions."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tabulon.operators.lookup import fits_broadcast
from tabulon.operators.ordering import running_totals
from tabulon.session import materialize

# Metrics where smaller is better; all others are ranked descending.
ASCENDING = ("rmse", "mae", "mape", "log_loss", "sse")
LOG_EPS = 1e-15


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """`label, prediction, count` for the pairs that occur."""
    return (
        pred.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
        .count()
    )


def per_class_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Support, precision, recall and F1 per class, from the confusion counts alone."""
    n, zero = F.col("count"), F.lit(0).cast("long")
    hit = F.when(F.col("label").eqNullSafe(F.col("prediction")), n).otherwise(zero)
    fields = ("class", "support", "predicted", "hits")
    as_label = F.struct(*[c.alias(a) for c, a in zip((F.col("label"), n, zero, hit), fields)])
    as_prediction = F.struct(*[c.alias(a) for c, a in zip((F.col("prediction"), zero, n, zero), fields)])
    sums = (
        confusion(pred, label, prediction)
        .select(F.inline(F.array(as_label, as_prediction)))
        .where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(*[F.sum(f).alias(f) for f in fields[1:]])
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return sums.select(
        "class",
        "support",
        ratio("hits", "predicted").alias("precision"),
        ratio("hits", "support").alias("recall"),
        F.coalesce(
            F.try_divide(2.0 * F.col("hits"), F.col("predicted") + F.col("support")), F.lit(0.0)
        ).alias("f1"),
        "hits",
    )


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: rows, accuracy, and macro and support-weighted precision, recall and F1."""
    per = per_class_metrics(pred, label, prediction)
    support = F.sum("support")
    return per.agg(
        support.alias("rows"),
        F.try_divide(F.sum("hits"), support).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[
            F.try_divide(F.sum(F.col(m) * F.col("support")), support).alias(f"weighted_{m}")
            for m in ("precision", "recall", "f1")
        ],
    )


def ranking_metrics(
    pred: DataFrame, label: str = "label", score: str = "score", probability: str | None = None
) -> DataFrame:
    """One row: positives, negatives, exact ROC AUC (ties count half) and log loss.

    Rows are first aggregated per distinct score; the negatives below each score are then a running
    total over range slices, never one window over all rows.
    """
    p = F.least(F.greatest(F.col(probability or score), F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
    y = F.col(label).cast("double")
    loss = -(y * F.ln(p) + (1 - y) * F.ln(1 - p)) if probability else F.lit(None).cast("double")
    usable = pred.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    by_score = usable.groupBy(F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"), F.sum(loss).alias("loss")
    )
    ranked = running_totals(by_score, [], ["score"], {"neg_upto": "neg"})
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    positives, negatives = F.sum("pos"), F.sum("neg")
    return ranked.agg(
        positives.alias("positives"),
        negatives.alias("negatives"),
        F.try_divide(wins, positives.cast("double") * negatives).alias("auc"),
        F.try_divide(F.sum("loss"), positives + negatives).alias("log_loss"),
    )


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: rows, RMSE, MAE, R², MAPE over non-zero labels, and mean error."""
    y, e = F.col(label).cast("double"), F.col(prediction).cast("double") - F.col(label)
    return pred.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).agg(
        F.count("*").alias("rows"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        F.avg(F.abs(F.try_divide(e, y))).alias("mape"),
        F.avg(e).alias("bias"),
    )


def cluster_metrics(pred: DataFrame, features: str = "features", cluster: str = "prediction") -> DataFrame:
    """`cluster, size, sse`: rows, and squared distances to the cluster's centre of mass."""
    x = F.col(features)
    if isinstance(pred.schema[features].dataType, T.ArrayType):
        x = array_to_vector(x.cast("array<double>"))
    stats = pred.groupBy(F.col(cluster).alias("cluster")).agg(
        Summarizer.metrics("count", "variance").summary(x).alias("s")
    )
    spread = F.aggregate("v", F.lit(0.0), lambda a, v: a + v)
    return stats.select(
        "cluster", F.col("s.count").alias("size"), vector_to_array("s.variance").alias("v")
    ).select("cluster", "size", (spread * (F.col("size") - 1)).alias("sse"))


def silhouette(pred: DataFrame, features: str = "features", cluster: str = "prediction") -> DataFrame:
    """`cluster, size, silhouette`: the mean silhouette of each cluster's rows under squared distances.

    The mean squared distance of x to a cluster of n rows with sum s and sum of squared norms q is
    |x|^2 + q / n - 2 x.s / n, so no pairs are formed: one aggregation gives n, s and q of every cluster,
    one more averages over the rows. Vectors are taken about the common mean, so that nothing
    cancels. A row alone in its cluster has silhouette 0, and so has every row when there is one cluster. Rows
    without a cluster or vector are left out.

    The clusters' sums are held with every row; they have to stay below a broadcast's size.
    """
    kind = pred.schema[features].dataType
    x = F.col(features).cast("array<double>") if isinstance(kind, T.ArrayType) else vector_to_array(features)
    rows = pred.select(F.col(cluster).alias("cluster"), x.alias("x")).where("cluster IS NOT NULL AND x IS NOT NULL")
    vector = array_to_vector("x")
    middle = rows.agg(vector_to_array(Summarizer.mean(vector)).alias("m")).scalar()
    rows = rows.withColumn("middle", middle).select("cluster", F.zip_with("x", "middle", lambda a, b: a - b).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda t, v: t + v * v)
    sums = materialize(
        rows.groupBy("cluster").agg(
            F.count("*").alias("n"), F.sum(square).alias("q"), vector_to_array(Summarizer.sum(vector)).alias("s")
        ),
        "cluster-sums",
    )
    if not fits_broadcast(sums):
        raise ValueError("too many clusters to compare every row with each of them")
    whole = sums.agg(F.collect_list(F.struct("cluster", "n", "q", "s")).alias("all"))
    dot = lambda c: F.aggregate(F.zip_with("x", c["s"], lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    sum_to = lambda c: F.greatest(c["n"] * F.col("xx") + c["q"] - 2 * dot(c), F.lit(0.0))
    near = F.transform("all", lambda c: F.struct(c["cluster"].alias("cluster"), c["n"].alias("n"), sum_to(c).alias("d")))
    rows = rows.withColumn("xx", square).crossJoin(F.broadcast(whole)).select("cluster", near.alias("near"))
    own = F.filter("near", lambda c: c["cluster"] == F.col("cluster"))[0]
    others = F.filter("near", lambda c: c["cluster"] != F.col("cluster"))
    rows = rows.select(
        "cluster", own["n"].alias("n"), F.try_divide(own["d"], own["n"] - 1).alias("a"),
        F.array_min(F.transform(others, lambda c: c["d"] / c["n"])).alias("b"),
    )
    alone = (F.col("n") == 1) | F.col("b").isNull() | (F.greatest("a", "b") == 0)
    value = F.when(alone, 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
    return rows.groupBy("cluster").agg(F.count("*").alias("size"), F.avg(value).alias("silhouette"))


def leaderboard(results: DataFrame) -> DataFrame:
    """Rank candidates per task from `task, model, metric, value`; the name breaks ties.

    Candidates without a value come last and are never the best.
    """
    signed = F.when(F.col("metric").isin(*ASCENDING), -F.col("value")).otherwise(F.col("value"))
    order = W.partitionBy("task").orderBy(F.desc_nulls_last("_signed"), "model")
    ranked = results.withColumn("_signed", signed).withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("is_best", (F.col("rank") == 1) & F.col("value").isNotNull()).drop("_signed")
