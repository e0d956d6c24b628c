"""One task record in, three stages out: profile, features, models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulon.functions.columns import literal_rows
from tabulon.functions.text import STAGES
from tabulon.operators import models as M
from tabulon.operators import transforms as R
from tabulon.operators.baselines import baseline
from tabulon.operators.features import guard
from tabulon.operators.profile import profile, profile_status
from tabulon.operators.selection import FeatureSelector, FeatureSelectorModel
from tabulon.operators.sessions import run_list
from tabulon.operators.splits import hash_split
from tabulon.sources.readers import load_dataset
from tabulon.session import materialize
from tabulon.sources.sinks import read_split, write_report, write_splits

KEY = "_key"


@dataclass
class Results:
    """What a run produced: one table per stage, the status rows, and the fitted models."""

    stages: list[str]
    profile: DataFrame | None = None
    plan: DataFrame | None = None
    leaderboard: DataFrame | None = None
    status: dict[str, DataFrame] = field(default_factory=dict)
    transformers: PipelineModel | None = None
    selection: FeatureSelectorModel | None = None
    model_path: str | None = None

    @property
    def ok(self) -> bool:
        return bool(self.stages) and all(
            name in self.status and self.status[name].first()["pipeline_status"] == "success"
            for name in self.stages
        )


@dataclass
class Options:
    """What a caller can add to a run.

    `candidates` are models of the caller's own beside the built-in ones (a name that is taken replaces the
    built-in one), `grids` parameter grids by candidate name, searched by hold-out, `steps` transformers that
    are applied to the raw table before it is profiled and split and are saved with the pipeline, `time_limit` the
    seconds a candidate may take.
    """

    candidates: Mapping[str, Estimator] = field(default_factory=dict)
    grids: Mapping[str, Sequence[dict]] = field(default_factory=dict)
    steps: Sequence[Transformer] = ()
    time_limit: float = M.TIME_LIMIT


def run(
    spark: SparkSession,
    info: Mapping,
    out: str,
    base: str = "",
    partitions: int | None = None,
    options: Options | None = None,
) -> Results:
    """Run the stages `info` asks for, with everything they need, and write their results to `out`.

    Every stage leaves a status report, also when it fails; later stages then do not run.
    """
    options = options or Options()
    requested = F.array(*[F.lit(a) for a in info.get("agents_to_call") or []]).cast("array<string>")
    stages = spark.range(1).select(run_list(requested).alias("r")).first()["r"]
    results, target = Results(stages), info.get("target_column") or None
    steps = {STAGES[0]: _profile, STAGES[1]: _features, STAGES[2]: _models}
    for stage in stages:
        try:
            status = steps[stage](spark, info, target, out, base, results, partitions, options)
        except Exception as failure:
            status = _failed(spark, stage, str(failure).strip() or type(failure).__name__)
        results.status[stage] = status
        write_report(status, f"{out}/reports/{stage}")
        if status.first()["pipeline_status"] != "success":
            break
    return results


def _failed(spark: SparkSession, stage: str, reason: str) -> DataFrame:
    return literal_rows(
        spark, [(stage, "failed", reason)], "stage string, pipeline_status string, pipeline_status_reason string"
    )


def _dataset(spark, info, base, options) -> DataFrame:
    return PipelineModel(list(options.steps)).transform(load_dataset(spark, info, base))


def _profile(spark, info, target, out, base, results, partitions, options) -> DataFrame:
    df = _dataset(spark, info, base, options)
    fatal = guard(df, target).where("fatal").select("problem").first()
    if fatal:
        return _failed(spark, STAGES[0], fatal["problem"])
    profile(df).write.mode("overwrite").parquet(f"{out}/profile")
    results.profile = spark.read.parquet(f"{out}/profile")
    return profile_status(df, results.profile, target)


def _features(spark, info, target, out, base, results, partitions, options) -> DataFrame:
    raw = _dataset(spark, info, base, options)
    # Equal rows share a key, so copies never end up on both sides of a split. Stored, as it is read many times.
    keyed = hash_split(raw.withColumn(KEY, F.md5(F.to_json(F.struct(*raw.columns)))), KEY).drop(KEY)
    keyed = materialize(keyed, "split")
    train = keyed.where("split = 'train'")
    results.plan = R.recommend(results.profile, target)
    made = R.fit_transforms(train, results.plan, f"{out}/tables")
    features = R.feature_columns(made, keyed, [c for c in (target, "split") if c])
    results.selection = FeatureSelector(inputCols=features).fit(made.transform(train))
    model = PipelineModel([*made.stages, results.selection])
    write_splits(model.transform(keyed), f"{out}/processed")
    M.save_pipeline(PipelineModel([*options.steps, *model.stages]), f"{out}/transformers")
    results.transformers = model
    paths = {"dataset": f"{out}/processed", "transformers": f"{out}/transformers"}
    report = R.feature_report(results.plan, results.selection.kept, paths)
    more = F.array(*[F.lit(c) for c in results.selection.getOrDefault("dropped")]).cast("array<string>")
    return report.withColumn("dropped_features", F.array_sort(F.array_union("dropped_features", more)))


def _models(spark, info, target, out, base, results, partitions, options) -> DataFrame:
    session = literal_rows(
        spark,
        [(0, info.get("task_type"), info.get("task_intent"), target)],
        "session_id long, task_type string, task_intent string, target_column string",
    )
    task = M.detect_task(session, results.profile).first()["task"]
    if task == "clustering":
        target = None
    train = read_split(spark, f"{out}/processed", "train")
    valid = read_split(spark, f"{out}/processed", "validation")
    features = list(results.status[STAGES[1]].first()["selected_features"])
    assembly = M.prepare(train, target, features, task == "classification")
    train, valid = M.prepared(assembly, train, target), M.prepared(assembly, valid, target)
    models = {**M.candidates(task, train), **options.candidates}
    models = {name: M.tuned(task, m, options.grids[name]) if name in options.grids else m for name, m in models.items()}
    fitted, rows = M.train_all(train, valid, models, task, partitions, options.time_limit)
    rows = rows.unionByName(_baselines(spark, task, train, valid)) if target else rows
    M.compare(rows, task).write.mode("overwrite").parquet(f"{out}/leaderboard")
    results.leaderboard = spark.read.parquet(f"{out}/leaderboard")
    ranked = [r["model"] for r in results.leaderboard.orderBy("rank").select("model").collect()]
    best = next((m for m in ranked if m in fitted), None)
    test = {}
    if best:
        results.model_path = f"{out}/model"
        M.save_pipeline(PipelineModel([*assembly.stages, fitted[best]]), results.model_path)
        held = M.prepared(assembly, read_split(spark, f"{out}/processed", "test"), target)
        test = M.evaluate(task, fitted[best].transform(held)) if not held.isEmpty() else {}
    return M.training_report(rows, results.model_path, best, features, f"{out}/processed", test)


def _baselines(spark, task, train, valid) -> DataFrame:
    """The constant prediction learned from the training rows, as a candidate to be beaten."""
    predicted = baseline(train.select("label"), valid.select("label"), "label", task)
    found = M.evaluate(task, predicted.withColumn("prediction", F.col("prediction").cast("double")))
    return literal_rows(spark, [(task, "constant", "success", None, k, float(v)) for k, v in found.items()], M.RESULT)
