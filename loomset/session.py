"""Session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "loomset", **conf: str) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave ``master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Broadcast by measured sizes only: files tell how large data is when compressed.
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="loomset-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/intermediates-{context.applicationId}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder all executors can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local session, whose
    executors live on this machine, may fall back to a temporary folder. The paths of one
    application are in a folder of their own, which ``remove_intermediates`` removes.
    """
    return f"{_shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove_intermediates(spark: SparkSession) -> None:
    """Remove what this application has written for itself, once its results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For results that are dear to compute, such as generated responses: later steps and lost
    executors then re-read the files instead of generating again.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
