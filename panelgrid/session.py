"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles methods above 8,000 bytecodes; wide projections run faster
    # as many small generated methods than as one that stays interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "panelgrid", **extra: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``master`` stays unset on a cluster, where the submit command names it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it; there is no other one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def with_own_folder(spark: SparkSession) -> SparkSession:
    """For trials on one machine: a session without a shared folder gets a temporary one."""
    one_machine = spark.conf.get("spark.master", "").startswith("local[") or spark.conf.get(
        "spark.master", "") == "local"
    if one_machine and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="panelgrid-"))
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never one used before."""
    return os.path.join(shared_folder(spark), "panelgrid", f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once as parquet in the shared folder and read back.

    Cuts lineage for frames several later jobs start from; files in the shared
    folder outlive the executors that wrote them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
