"""Session helpers: building a session, shipping the package to executors, shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Rows of an Arrow batch: Spark's own default is for narrow rows; texts and payloads are kilobytes each.
BATCH_KEY, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def build_session(app_name: str = "tidewire", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return attach(builder.getOrCreate())


def attach(spark: SparkSession) -> SparkSession:
    """Prepare an existing session: UTC times, smaller Arrow batches unless set, and this package importable in Python workers."""
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark, Path(__file__).resolve().parent)
    return spark


def ship(spark: SparkSession, package: Path) -> None:
    """Send a package folder to the Python workers, once per application."""
    archive_name = f"{package.name}_pkg.zip"
    sc = spark.sparkContext
    if any(path.endswith(archive_name) for path in sc.listFiles):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tidewire-"), archive_name)
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, Path(package.name) / source.relative_to(package))
    sc.addPyFile(target)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local session that names none (tests) gets one of its own.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="tidewire-shared-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder name under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows read back from a table under the shared folder.

    Cuts lineage like ``checkpoint``, which would run the last stage twice and keep rows instead of columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables under the shared folder, deleted by their owner once no later step reads them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self._paths = spark, label, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.label)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, folder = self._paths.pop(id(table))
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
