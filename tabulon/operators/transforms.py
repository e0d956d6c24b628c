"""From a profile to a fitted, persistable feature pipeline.

`recommend` turns profile rows into steps by fixed rules. `fit_transforms` learns the steps'
parameters from the training rows only and returns a Spark ML `PipelineModel`: numeric parameters
become literals of SQL projections (one fused projection at run time), per-category tables are
written next to the model and joined by size-checked lookups.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tabulon.functions.columns import col, family, long_aggregate, number, present
from tabulon.operators.lookup import lookup
from tabulon.operators.profile import TOKEN_BREAK, categorical_summary, quartiles

MISSING_LIMIT = 0.6
OUTLIER_SHARE = 0.01
FEW_CATEGORIES = 20


def recommend(profiled: DataFrame, target: str | None = None) -> DataFrame:
    """`column, ordinal, step, reason` for every column but the target.

    Rules: id, constant, complex, or missing share above 0.6 -> drop; missing numbers -> median;
    missing categories -> mode; missing dates -> parts of the mean date and a flag; more than 1 % outside the outlier bounds -> clip; at most 20
    categories -> one-hot, more -> frequency encoding; numbers -> standardize; dates -> parts;
    text -> length and token count; booleans -> 0/1.
    """
    kind, gap = F.col("kind"), F.col("missing_share")
    filled = F.col("rows") - F.col("missing")
    drop = kind.isin("id", "constant", "complex") | (gap > MISSING_LIMIT)
    step = lambda n, name, why, when: F.when(
        when, F.struct(F.lit(n).alias("ordinal"), F.lit(name).alias("step"), why.alias("reason"))
    )
    why = lambda text: F.lit(text)
    steps = F.array(
        step(0, "drop", F.when(kind.isin("id", "constant", "complex"), kind).otherwise("missing"), drop),
        step(1, "impute_median", why("missing values"), ~drop & (kind == "numeric") & (gap > 0)),
        step(1, "impute_mode", why("missing values"), ~drop & kind.isin("categorical", "boolean") & (gap > 0)),
        step(1, "impute_date", why("missing values"), ~drop & (kind == "datetime") & (gap > 0)),
        step(
            2, "clip", why("outliers"),
            ~drop & (kind == "numeric") & (F.try_divide(F.col("low") + F.col("high"), filled) > OUTLIER_SHARE),
        ),
        step(3, "one_hot", why("few categories"), ~drop & (kind == "categorical") & (F.col("distinct_count") <= FEW_CATEGORIES)),
        step(3, "frequency_encode", why("many categories"), ~drop & (kind == "categorical") & (F.col("distinct_count") > FEW_CATEGORIES)),
        step(3, "to_number", why("boolean"), ~drop & (kind == "boolean")),
        step(3, "date_parts", why("datetime"), ~drop & (kind == "datetime")),
        step(3, "text_size", why("text"), ~drop & (kind == "text")),
        step(4, "standardize", why("numeric"), ~drop & (kind == "numeric")),
    )
    rows = profiled.where(F.col("column") != target) if target else profiled
    return rows.select("column", F.inline(F.array_compact(steps)))


class TableEncoder(
    Transformer, DefaultParamsReadable, DefaultParamsWritable
):
    """Adds `outputCol` from a stored `key -> code` table; unseen keys get `default`."""

    inputCol = Param(Params._dummy(), "inputCol", "key column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "code column", TypeConverters.toString)
    tablePath = Param(Params._dummy(), "tablePath", "parquet table of key and code", TypeConverters.toString)
    default = Param(Params._dummy(), "default", "code of unseen keys", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, tablePath=None, default=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        key, out = get("inputCol"), get("outputCol")
        table = df.sparkSession.read.parquet(get("tablePath")).select(
            F.col("key").alias(key), F.col("code").alias("_code")
        )
        joined = lookup(df, table, [key], stored=True)
        kept = [col(c) for c in df.columns if c != out]
        return joined.select(*kept, F.coalesce("_code", F.lit(get("default"))).alias(out))


def _name(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def _text(v) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(v: float) -> str:
    return f"{float(v)!r}D"


def _projection(replaced: list[str], made: dict[str, str]) -> SQLTransformer:
    """Drop `replaced`, add `made`, and pass every other column through, whatever it is."""
    rest = f"* EXCEPT ({', '.join(map(_name, replaced))})" if replaced else "*"
    body = ", ".join([rest, *[f"{sql} AS {_name(c)}" for c, sql in made.items()]])
    return SQLTransformer(statement=f"SELECT {body} FROM __THIS__")


def _present_sql(df: DataFrame, c: str) -> str:
    if df.schema[c].dataType.simpleString() in ("float", "double"):
        return f"CASE WHEN NOT isnan({_name(c)}) THEN CAST({_name(c)} AS DOUBLE) END"
    return f"CAST({_name(c)} AS DOUBLE)"


def _mean_dates(train: DataFrame, columns: list[str]) -> dict[str, tuple[int, ...]]:
    """Year, month, day and weekday of the mean date of each column; of 1970-01-01 without any."""
    if not columns:
        return {}
    means = train.agg(*[F.avg(F.unix_seconds(col(c).cast("timestamp"))).alias(f"m{i}") for i, c in enumerate(columns)])
    parts = lambda d: F.struct(F.year(d), F.month(d), F.day(d), F.dayofweek(d) - 1)
    row = means.select(
        *[parts(F.timestamp_seconds(F.coalesce(F.col(f"m{i}"), F.lit(0.0)))).alias(f"p{i}") for i in range(len(columns))]
    ).first()
    return {c: tuple(row[i]) for i, c in enumerate(columns)}


def fit_transforms(
    train: DataFrame, plan: DataFrame, tables: str, few_categories: int = FEW_CATEGORIES
) -> PipelineModel:
    """Fit the recommended steps on `train`; columns the plan does not name pass through.

    No numeric output is null: what the plan does not fill becomes 0, the mean after standardizing,
    and the parts of a missing date are those of the mean date of `train`. A column planned for
    one-hot encoding that has more than `few_categories` values by now is frequency-encoded.

    `tables` is the folder for per-category tables. The plan has a few rows per column and is
    fetched; everything learned from data is an aggregate of `train`.
    """
    steps: dict[str, list[str]] = {}
    for r in plan.orderBy("column", "ordinal").collect():
        steps.setdefault(r["column"], []).append(r["step"])
    having = lambda *names: [c for c in train.columns if set(steps.get(c, ())) & set(names)]
    stages = []
    dates = _mean_dates(train, having("date_parts"))
    values: dict[str, list] = {}
    for c in having("one_hot"):
        seen = train.select(present(train, c).alias("v")).where("v is not null").distinct().limit(few_categories + 1)
        values[c] = sorted((r["v"] for r in seen.collect()), key=str)
        if len(values[c]) > few_categories:
            steps[c] = ["frequency_encode" if x == "one_hot" else x for x in steps[c]]

    quart = quartiles(train, having("impute_median", "clip")) if having("impute_median", "clip") else {}
    gaps = having("impute_mode")
    modes = {}
    if gaps:
        modes = {r["column"]: r["mode"] for r in categorical_summary(train, gaps).collect()}
    first = {}
    for c in having("standardize", "impute_mode"):
        todo, sql = steps[c], _name(c)
        if "standardize" in todo:
            sql = _present_sql(train, c)
            q = quart.get(c)
            if "impute_median" in todo and q[1] is not None:
                sql = f"coalesce({sql}, {_number(q[1])})"
            if "clip" in todo and q[0] is not None:
                spread = 1.5 * (q[2] - q[0])
                low, high = _number(q[0] - spread), _number(q[2] + spread)
                sql = f"CASE WHEN {sql} < {low} THEN {low} WHEN {sql} > {high} THEN {high} ELSE {sql} END"
        elif "impute_mode" in todo and modes.get(c) is not None:
            sql = f"coalesce({sql}, CAST({_text(modes[c])} AS {train.schema[c].dataType.simpleString()}))"
        first[c] = sql
    stages.append(_projection([*having("drop"), *first], first))
    cleaned = stages[0].transform(train)

    scaled = having("standardize")
    scale = {}
    if scaled:
        stats = long_aggregate(
            cleaned, scaled,
            {"mean": lambda c: F.avg(number(cleaned, c)), "std": lambda c: F.stddev_samp(number(cleaned, c))},
        )
        scale = {r["column"]: (r["mean"], r["std"]) for r in stats.collect()}
    second = {}
    rewritten = having("standardize", "one_hot", "date_parts", "text_size", "to_number")
    for c in rewritten:
        todo, sql = steps[c], _name(c)
        if "standardize" in todo:
            mean, std = scale[c]
            second[c] = f"coalesce(({sql} - {_number(mean)}) / {_number(std)}, 0D)" if std else "0D"
        elif "one_hot" in todo:
            for v in values[c]:
                match = f"CAST({sql} AS STRING) = {_text(v)}"
                second[f"{c}_{v}"] = f"CASE WHEN {match} THEN 1 ELSE 0 END"
        elif "date_parts" in todo:
            year, month, day, weekday = dates[c]
            second[f"{c}_year"], second[f"{c}_month"] = f"coalesce(year({sql}), {year})", f"coalesce(month({sql}), {month})"
            second[f"{c}_day"] = f"coalesce(day({sql}), {day})"
            second[f"{c}_weekday"] = f"coalesce(dayofweek({sql}) - 1, {weekday})"
            second[f"{c}_weekend"] = f"CASE WHEN coalesce(dayofweek({sql}) - 1, {weekday}) IN (0, 6) THEN 1 ELSE 0 END"
            if "impute_date" in todo:
                second[f"{c}_missing"] = f"CASE WHEN {sql} IS NULL THEN 1 ELSE 0 END"
        elif "text_size" in todo:
            second[f"{c}_length"] = f"coalesce(length({sql}), 0)"
            words = f"filter(split({sql}, {_text(TOKEN_BREAK)}), t -> t != '')"
            second[f"{c}_tokens"] = f"coalesce(size({words}), 0)"
        elif "to_number" in todo:
            second[c] = f"coalesce(CAST({sql} AS INT), 0)"
    stages.append(_projection(rewritten, second))

    for c in having("frequency_encode"):
        path = f"{tables}/{c}"
        total = cleaned.agg(F.count(present(cleaned, c)).alias("n")).scalar()
        (
            cleaned.select(present(cleaned, c).alias("key")).where("key is not null").groupBy("key")
            .agg(F.count("*").alias("n")).select("key", (F.col("n") / total).alias("code"))
            .write.mode("overwrite").parquet(path)
        )
        stages.append(TableEncoder(inputCol=c, outputCol=f"{c}_freq", tablePath=path, default=0.0))
    encoded = having("frequency_encode")
    if encoded:
        stages.append(_projection(encoded, {}))
    return PipelineModel(stages)


def feature_columns(model: PipelineModel, df: DataFrame, passthrough: list[str]) -> list[str]:
    """The numeric output columns of a fitted pipeline, without the columns passed through."""
    out = model.transform(df)
    return [
        f.name for f in out.schema.fields
        if f.name not in passthrough and family(f.dataType) in ("integral", "floating", "boolean")
    ]


def feature_report(plan: DataFrame, features: list[str], paths: dict[str, str]) -> DataFrame:
    """The stage's status row. Only paths that hold written files are reported."""
    spark = plan.sparkSession
    written = {k: p for k, p in paths.items() if _has_files(spark, p)}
    absent = sorted(set(paths) - set(written))
    reason = f"not written: {', '.join(absent)}" if absent else None
    if not features:
        reason = "no usable feature column"
    dropped = F.array_sort(F.collect_set(F.when(F.col("step") == "drop", F.col("column"))))
    return plan.agg(dropped.alias("dropped_features")).select(
        F.lit("FeatureEngineeringAgent").alias("stage"),
        F.lit("failed" if reason else "success").alias("pipeline_status"),
        F.lit(reason).cast("string").alias("pipeline_status_reason"),
        F.array(*[F.lit(f) for f in features]).cast("array<string>").alias("selected_features"),
        "dropped_features",
        F.lit(written.get("dataset")).cast("string").alias("dataset_path"),
        F.lit(written.get("transformers")).cast("string").alias("transformer_path"),
    )


def _has_files(spark, path: str) -> bool:
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return bool(files.select("path").take(1))
    except Exception:
        return False
