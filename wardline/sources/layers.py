"""Stored layers: a layer is written once and later queries scan its columns."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: dict[str, str] = {}
_LAYERS: dict[tuple, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is configured, a local master (tests) gets a
    temporary one, deleted at exit; any other master is an error, since machines would not
    see each other's files."""
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="wardline-")
        atexit.register(shutil.rmtree, _LOCAL_ROOT[app], ignore_errors=True)
    return _LOCAL_ROOT[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, key: str, build) -> DataFrame:
    """The layer named by key: built and written on first use, then read back."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _LAYERS:
        path = scratch_path(spark, "layer")
        build().write.parquet(path)
        _LAYERS[slot] = path
        release_shuffles(spark)
    return spark.read.parquet(_LAYERS[slot])


def folder(spark: SparkSession, key: str, build) -> str:
    """The folder named by key: build(path) fills it on first use."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _LAYERS:
        path = scratch_path(spark, "folder")
        build(path)
        _LAYERS[slot] = path
    return _LAYERS[slot]


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: a small intermediate that
    several later steps scan, without repeating the work that made it."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table that this module's callers wrote and no longer read."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: they
    stay on the executors' disks until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
