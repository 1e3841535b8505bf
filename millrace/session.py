"""Session set-up, and the few helpers that touch the session's settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with the settings the operators are written for; on a cluster the submitter's settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in local tests, a
    temporary folder is made and set as checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="millrace-")
        sc.setCheckpointDir(base)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors, is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{what}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, waves: int = 3) -> DataFrame:
    """Rows dealt out evenly when the files give fewer tasks than the cluster has cores.

    For stages that spend far more CPU on a row than the exchange of its bytes costs. Where the scan
    already has enough splits, nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores * waves else df.repartition(cores * waves)
