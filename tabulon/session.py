"""Session settings and the shared scratch area every multi-step operator writes to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "tabulon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; `conf` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    A local session without the setting gets a temporary folder; a cluster session without it is
    an error, because a folder on one machine would not be visible to the other executors.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    return _local_root(context.applicationId)


@cache
def _local_root(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"tabulon-{application}-")


@cache
def _package_archive() -> str:
    """The package as a zip file, for workers that do not have it installed."""
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tabulon-package-")) / "tabulon.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    return str(archive)


@cache
def _ship(application: str) -> None:
    SparkContext.getOrCreate().addPyFile(_package_archive())


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers, once per application."""
    _ship(spark.sparkContext.applicationId)


def _application_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/tabulon/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's part of the shared folder."""
    return f"{_application_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the steps this application has written, once its results are written elsewhere or read."""
    jvm, path = spark.sparkContext._jvm, _application_scratch(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and gives the optimizer the real size
    of the table, so later joins are planned from facts.
    """
    ship_package(df.sparkSession)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
