"""A Spark session with this package's defaults; a cluster's own settings win."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "orespark", **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=DEFAULTS | more).getOrCreate()


def relieve_driver(spark: SparkSession, taken: float = 0.25) -> None:
    """Let the driver's JVM collect its garbage, if more than this part of its heap is taken, and return what is free then. What
    finished queries leave can stay until the whole heap is collected, and the heap grows around it."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > taken * heap.maxMemory():
        gc.collect()  # Python's objects hold some of the JVM's
        spark._jvm.java.lang.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it isn't set, a session that is one process
    gets a temporary folder; on a cluster that is an error, for nobody could read what another machine wrote there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="orespark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")
