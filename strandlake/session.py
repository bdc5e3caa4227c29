"""Spark sessions with the settings that the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: What the names of scratch folders begin with.
SCRATCH = "scratch"


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings given here or by spark-submit stand before these."""
    builder = SparkSession.builder.appName("strandlake")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where all tasks run on this machine."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if (spark.sparkContext.master or "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
    return f"{base}/{SCRATCH}-{name}-{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession) -> None:
    """Deletes all folders and files that scratch_dir has named below spark.checkpoint.dir; frames that read them cannot be computed any more."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        return
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.listStatus(folder) if store.exists(folder) else ():
        if found.getPath().getName().startswith(f"{SCRATCH}-"):
            store.delete(found.getPath(), True)
