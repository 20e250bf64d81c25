"""SparkSession helpers: one place for the settings the operators assume."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "carelake", cpus: int | str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Local/test session. On a cluster, build the session with cluster settings
    and call :func:`ensure_checkpoint_dir` instead of this."""
    cpus = cpus or os.environ.get("CARELAKE_CPUS", "*")
    parts = shuffle_partitions or int(os.environ.get("CARELAKE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("CARELAKE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to shared storage; only when it is
    unset (local runs and tests) a scratch folder is created for it.
    """
    sc = spark.sparkContext
    try:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # not a runtime SQL conf in some deployments
        configured = None
    current = configured or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="carelake-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def cut_lineage(df):
    """``df`` as a reliable checkpoint in the shared checkpoint folder: later jobs neither
    repeat the work nor depend on the executors that did it. Its plan is run once; the files
    go when the frame is no longer used, where ``cleanCheckpoints`` is on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
