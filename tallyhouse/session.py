"""Spark session and scratch-folder settings shared by jobs, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "tallyhouse", **conf: str) -> SparkSession:
    """Session with the settings every operator here relies on.

    A cluster passes no master: the launcher decides where to run and how many shuffle
    partitions to start from. AQE then coalesces small partitions and splits skewed joins.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_base: str | None = None


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table or a stream checkpoint.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local session
    without that setting falls back to a temporary folder of this machine.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None) or _local_base
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_base = tempfile.mkdtemp(prefix="tallyhouse-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(spark, "lineage"))
    return df.checkpoint(eager=True)
