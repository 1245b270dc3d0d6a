"""Source files as a table (service, path, text), read once for all scanners."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def existing(spark: SparkSession, root: str) -> bool:
    """Whether there is a folder; on any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and fs.getFileStatus(path).isDirectory()


def source_files(spark: SparkSession, repos: Mapping[str, str], glob: str = "*") -> DataFrame:
    """(service, path, text, relative) of every file below each service's root; ``path`` is the whole one, ``relative`` begins at the root.

    All roots are read by one scan.  A file below two roots belongs to both services; roots that aren't there are an error (see ``existing``).
    """
    if not repos:
        return spark.createDataFrame([], "service string, path string, text string, relative string")
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    whole = {}
    for service, root in repos.items():
        path = jpath(root)
        whole[service] = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/") + "/"
    # A root below another one is read with it.
    outer = [r for s, r in repos.items() if not any(whole[s].startswith(w) and (len(w) < len(whole[s]) or t < s) for t, w in whole.items() if t != s)]
    read = spark.read.text(outer, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    at = F.regexp_replace(F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "^/+", "/")
    below = F.array(*[F.struct(F.lit(s).alias("service"), F.lit(w).alias("root")) for s, w in whole.items()])
    each = read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), at.alias("__at"))
    each = each.select("path", "text", "__at", F.explode(F.filter(below, lambda x: F.startswith(F.col("__at"), x["root"]))).alias("x"))
    return each.select("x.service", "path", "text", F.substr("__at", F.length("x.root") + 1).alias("relative"))


def fingerprints(files: DataFrame) -> DataFrame:
    """(name, git_hash): a change token per service from the paths and the content of its files.

    Files are summed up as numbers from their hashes, which no order matters to, so a service's files are added up where they
    are read and never stand together.
    """
    digest = F.sha2(F.concat(F.col("path"), F.lit(" "), F.sha2(F.coalesce("text", F.lit("")), 256)), 256)
    parts = [F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)") for k in range(5)]
    sums = files.groupBy(F.col("service").alias("name")).agg(*[F.sum(p).alias(f"__{k}") for k, p in enumerate(parts)], F.count(F.lit(1)).alias("__n"))
    return sums.select("name", F.sha2(F.concat_ws(",", "__n", *[f"__{k}" for k in range(5)]), 256).alias("git_hash"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"([^/]*)/[^/]*$", 1)).otherwise("")


def has_segment(path: Column, names: list[str]) -> Column:
    """Whether some part of the path is one of the names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def has_part(path: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(path, F.lit(p))
    return out
