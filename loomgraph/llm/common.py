"""Shared pieces: the scratch area, input tables and byte-level word splitting."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words between ASCII white space, as a regular expression.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of letters, digits and everything beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lower-cases A-Z and turns every other ASCII character that is in no word into a space.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_own_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode, where it may be unset, one of this process."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if shared:
        return shared.rstrip("/")
    if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return _own_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cuts the lineage with a written table in the shared folder, which outlives the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def bucketed(df: DataFrame, name: str, column: str) -> tuple[DataFrame, int]:
    """As ``materialise``, hashed by a column into so many buckets: a join by it with rows repartitioned to as many leaves the table where it is.

    The table's entry in the catalog goes when the driver ends, its files with the shared folder's others.
    """
    spark = df.sparkSession
    buckets, path = min(50_000, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))), scratch_path(spark, name)
    entry = path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").option("path", path).option("compression", "uncompressed").bucketBy(buckets, column).saveAsTable(entry)
    atexit.register(_drop, spark, entry)
    return spark.table(entry), buckets


def _drop(spark: SparkSession, entry: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        spark.sql(f"DROP TABLE IF EXISTS {entry}")


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more; Spark drops the shuffle files of plans that are gone when these are collected."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t._scratch_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark = SparkSession.getActiveSession()
    spark._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of one stays small however long its texts are."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """The texts of a batch in UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


#: Keys that may be broadcast to leave rows out, 8 bytes each.
BROADCAST_KEYS = 1_000_000


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is none of the keys; a null is none of them.  The keys go to the executors while they are few."""
    keys = materialise(keys.select(column).distinct(), "left-out")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, column, "left_anti")
