"""Intermediate results as written tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: So many rows may be sent to all executors, and so pass through the driver.
FEW = 2000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or, in local mode, where that may be unset, below a folder of this process; it goes when the driver ends."""
    root = spark.conf.get("spark.checkpoint.dir", "").rstrip("/")
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    path = f"{root}/loomgraph/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(rows: DataFrame, name: str) -> DataFrame:
    """The rows written and read again: computed once however often they are used, and safe from lost executors."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path)
    written._scratch_path = path
    return written


def few(rows: DataFrame) -> bool:
    """Whether there are few rows; for tables of ``cut`` this looks at the ends of their files."""
    return rows.limit(FEW + 1).count() <= FEW


def dealt(rows: DataFrame, many: bool = True) -> DataFrame:
    """Rows whose next join deals both sides by key, where there are many.

    Spark takes the size of files for the size of what is read from them, though it is packed there and arrays explode to many rows, and
    would send hundreds of MB through the driver.
    """
    return rows.hint("merge") if many else rows


def release(*tables: DataFrame) -> None:
    """Removes tables of ``cut`` that nothing reads any more; Spark drops the shuffle files of plans that are gone when these are collected."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    SparkSession.active()._jvm.System.gc()
