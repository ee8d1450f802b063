"""Session helpers: settings, and where intermediate rows are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "repometrics", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tested with."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # intermediate rows go with the frame that holds them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # recording the call site of every column expression slows plan building down
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate rows.

    The session's ``spark.checkpoint.dir`` decides.  Only a local session
    without one gets a temporary folder; on a cluster that would be a
    machine-local path, so it is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="repometrics-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write the rows once and go on from the written copy.

    Used where several branches read the same reduced table, or where a row's
    partition number must not change when a task is run again.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder of this application in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}-{name}"
