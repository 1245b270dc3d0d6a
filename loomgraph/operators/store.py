"""The graph's tables on disk.

Tables are written beside the old version under a new name and then pointed to, so a reader never sees
half a table and a lost executor only repeats its own files.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph import schema
from loomgraph.operators.dedup import last_wins
from loomgraph.operators.stats import stale

TABLES = {"nodes": schema.NODE, "edges": schema.EDGE, "token_idf": schema.TOKEN_IDF, "repo_state": schema.REPO_STATE, "feedback": schema.FEEDBACK, "clusters": schema.CLUSTER}


def conform(rows: DataFrame, wanted: T.StructType) -> DataFrame:
    """``rows`` with exactly the wanted columns; those of an older version that are missing are null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


class GraphStore:
    """Nodes, edges, token weights, scan state and feedback below one folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self, table: str) -> list[str]:
        fs, path = self._path(table)
        names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.toString() for p in names if fs.exists(done(p, "_SUCCESS")))

    def exists(self, table: str) -> bool:
        return bool(self._versions(table))

    def read(self, table: str) -> DataFrame:
        """The latest version; an empty table if there is none.  Rows of older layouts get the columns they lack."""
        found = self._versions(table)
        if not found:
            return self.spark.createDataFrame([], TABLES[table])
        rows = self.spark.read.option("mergeSchema", True).parquet(found[-1])
        if table == "feedback":
            rows = rows.withColumn("source", F.coalesce("source", F.lit("manual")) if "source" in rows.columns else F.lit("manual"))
        return conform(rows, TABLES[table])

    def overwrite(self, table: str, rows: DataFrame, keep: int = 2) -> None:
        """A new version; of older ones the latest stays for readers that have begun."""
        path = f"{self.root}/{table}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        conform(rows, TABLES[table]).write.parquet(path)
        fs, _ = self._path(table)
        for old in self._versions(table)[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(old), True)

    def append_feedback(self, rows: DataFrame) -> None:
        """Feedback is only added to; an index rebuilt leaves it alone."""
        found = self._versions("feedback")
        if found:
            conform(rows, schema.FEEDBACK).write.mode("append").parquet(found[-1])
        else:
            self.overwrite("feedback", rows)

    def upsert_nodes(self, rows: DataFrame, seq: str = "seq") -> None:
        """Of nodes with one id, stored or new, the last stays."""
        both = self.read("nodes").withColumn(seq, F.lit(-1).cast("bigint")).unionByName(rows.withColumn(seq, F.col(seq).cast("bigint")), allowMissingColumns=True)
        self.overwrite("nodes", last_wins(both, ["id"], seq))

    def replace_services(self, rows: DataFrame, services: Collection[str]) -> None:
        """Puts new nodes in the place of all nodes of the services; nodes without a service stay."""
        gone = F.coalesce(F.col("service").isin(list(services)), F.lit(False)) if services else F.lit(False)
        self.overwrite("nodes", self.read("nodes").where(~gone).unionByName(conform(rows, schema.NODE)))

    def clear_edges(self) -> None:
        self.overwrite("edges", self.spark.createDataFrame([], schema.EDGE))

    def clear_clusters(self) -> None:
        self.overwrite("clusters", self.spark.createDataFrame([], schema.CLUSTER))

    def insert_clusters(self, rows: DataFrame) -> None:
        """Adds clusters to those that are stored."""
        self.overwrite("clusters", self.read("clusters").unionByName(conform(rows, schema.CLUSTER)))

    def upsert_state(self, rows: DataFrame) -> None:
        new = conform(rows, schema.REPO_STATE)
        self.overwrite("repo_state", without_keys(self.read("repo_state"), new, ["name"]).unionByName(new))

    def prune(self, configured: DataFrame) -> list[str]:
        """Drops nodes and state of services that are no longer configured, and returns their names."""
        gone = pruned_services(self.read("nodes"), self.read("repo_state"), configured)
        names = sorted(r["service"] for r in gone.collect())  # services, not nodes: as many as a configuration names
        if names:
            self.replace_services(self.spark.createDataFrame([], schema.NODE), names)
            self.overwrite("repo_state", self.read("repo_state").where(~F.col("name").isin(names)))
        return names

    def write_manifest(self, config_path: str) -> None:
        fs, path = self._path("manifest.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps({"config_path": config_path}).encode()))
        out.close()

    def diagnose(self, as_of=None) -> list[str]:
        """What keeps the index from being used, or makes its answers old."""
        if not self.exists("nodes"):
            return ["no index: scan first"]
        if self.read("nodes").isEmpty():
            return ["the index has no nodes: check the configuration"]
        warning = stale(self.read("repo_state"), as_of).first()["warning"] if as_of is not None else None
        return [warning] if warning else []


def without_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti").select(*rows.columns)


def pruned_services(nodes: DataFrame, state: DataFrame, configured: DataFrame) -> DataFrame:
    """(service) indexed or recorded, but not configured."""
    known = nodes.select("service").union(state.select("name")).distinct()
    return known.join(configured.select("service"), "service", "left_anti")


def changed_services(current: DataFrame, state: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, git_hash, rescan): a service is read anew if its change token differs, or it has no nodes."""
    known = state.select("name", F.col("git_hash").alias("__old"))
    indexed = nodes.select(F.col("service").alias("name")).distinct().withColumn("__has", F.lit(True))
    both = current.join(known, "name", "left").join(indexed, "name", "left")
    same = F.col("git_hash").isNotNull() & (F.col("git_hash") == F.col("__old")) & F.col("__has").isNotNull()
    return both.select("name", "git_hash", (~F.coalesce(same, F.lit(False))).alias("rescan"))
