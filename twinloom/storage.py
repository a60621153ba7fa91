"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent (local runs, tests) a local folder is chosen and
    written into the session's settings, so that every caller sees the same one. On a
    cluster, where machines do not share local folders, its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not in_one_process(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="twinloom-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def in_one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    It cuts the lineage like a checkpoint and survives lost executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return back


_paths: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def delete(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` returned and that nothing will read again."""
    for t in tables:
        _delete(t.sparkSession, t.written_to)


def release(*tables: DataFrame) -> None:
    """Deletes tables that :func:`written` returned and that nothing will read again.

    The driver also drops what it holds of finished plans, whereupon Spark removes their shuffle files. Plans that Python
    let go of reach the JVM's garbage a moment later, so it is collected twice.
    """
    spark = SparkSession.active()
    delete(*tables)
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.5)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; results that still read them must have been used."""
    for path in _paths.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)
