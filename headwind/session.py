"""Session defaults and the shared folder used to cut long lineages."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "headwind", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and sc.getCheckpointDir() is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="headwind-"))
    return configured or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table or a stream."""
    return f"{shared_dir(spark).rstrip('/')}/headwind/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_dealt(df: DataFrame) -> DataFrame:
    """``cut`` that keeps by which key the rows are dealt, so that joins and folds by that key shuffle nothing.

    Only a plan that is fixed beforehand hands this on, so adaptive execution is off for this one.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df)
    finally:
        conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Shuffle and checkpoint files of tables that nothing refers to any more go now, not when the driver next happens to collect."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
