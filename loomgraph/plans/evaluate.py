"""Ranking quality: judgments against ranked clusters, and a literal-search baseline beside it."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.substrings import contained
from loomgraph.plans.query import query

TOP_K, DEPTH = 5, 10


def cluster_ids(results: DataFrame) -> DataFrame:
    """Results with ``ids``: the ids of their nodes, those of node_ids first where there is such a column."""
    nodes = F.transform("nodes", lambda n: n["id"])
    own = F.coalesce("node_ids", F.array().cast("array<string>")) if "node_ids" in results.columns else F.array().cast("array<string>")
    return results.withColumn("ids", F.array_distinct(F.filter(F.concat(own, nodes), lambda x: F.coalesce(x, F.lit("")) != "")))


def judge(results: DataFrame, judgments: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(judgment_id, hint, k, match, hit, rank, matched_node_ids): the first cluster up to k that has any, or all, expected nodes."""
    ranked = cluster_ids(results).select("hint_id", F.col("rank").alias("at"), "ids")
    asked = judgments.withColumn("k", F.coalesce("k", F.lit(top_k)))
    both = F.array_intersect("expected_node_ids", "ids")
    every = F.size(F.array_except("expected_node_ids", "ids")) == 0
    met = asked.join(ranked, "hint_id").where((F.col("at") <= F.col("k")) & F.when(F.col("match") == "all", every).otherwise(F.size(both) > 0))
    first = met.groupBy("judgment_id").agg(F.min("at").alias("rank"), F.min_by(F.array_sort(both), "at").alias("matched_node_ids"))
    out = asked.join(first, "judgment_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "judgment_id", "hint", "k", "match", F.col("rank").isNotNull().alias("hit"), "rank", F.coalesce("matched_node_ids", none).alias("matched_node_ids")
    )


def metrics(judged: DataFrame) -> DataFrame:
    """(total, hits, hit_rate, mrr)."""
    return judged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("hit").alias("hits"),
        F.avg(F.col("hit").cast("int")).alias("hit_rate"),
        F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def evaluate(nodes: DataFrame, edges: DataFrame, judgments: DataFrame, top_k: int = TOP_K, depth: int | None = None, feedback: DataFrame | None = None) -> DataFrame:
    """Judged rows of all judgments (judgment_id, hint, expected_node_ids, match, k) from one batch of queries.

    Each hint is answered to the same depth whatever k is, so runs with other k compare.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    if depth is not None and depth < top_k:
        raise ValueError("depth must be at least top_k")
    hints = judgments.select("hint").distinct().withColumn("hint_id", F.xxhash64("hint"))
    asked = judgments.withColumn("hint_id", F.xxhash64("hint"))
    most = asked.agg(F.max("k")).first()[0] or 0
    return judge(query(nodes, edges, hints, max(depth or max(DEPTH, top_k), most), feedback), asked, top_k)


def gate(scores: DataFrame, min_hit_rate: float | None = None, min_mrr: float | None = None) -> DataFrame:
    """Metrics with ``passed``: whether they reach what is asked."""
    ok = F.lit(True)
    if min_hit_rate is not None:
        ok = ok & (F.col("hit_rate") >= min_hit_rate)
    if min_mrr is not None:
        ok = ok & (F.col("mrr") >= min_mrr)
    return scores.withColumn("passed", ok)


def literal_search(lines: DataFrame, hints: DataFrame) -> DataFrame:
    """(hint_id, path, line, text, rank): lines that hold a hint in any case, in the order of path, line and text.

    lines: (path, line, text).  Each line is walked once for all hints.
    """
    met = contained(lines.select("path", "line", "text"), [F.lower("text")], hints.select("hint_id", "hint"), F.lower("hint"))
    order = Window.partitionBy("hint_id").orderBy("path", "line", "text")
    return met.select("hint_id", "path", "line", F.trim("text").alias("text")).withColumn("rank", F.row_number().over(order))


def relevant_rank(found: DataFrame, locators: DataFrame) -> DataFrame:
    """(hint_id, rank) of the first line that some locator (path_suffix, contains) of the hint accepts."""
    fits = F.exists("locators", lambda x: F.endswith("path", x["path_suffix"]) & F.contains(F.lower("text"), F.lower(x["contains"])))
    return found.join(locators, "hint_id").where(fits).groupBy("hint_id").agg(F.min("rank").alias("rank"))


def summarize(rows: DataFrame) -> DataFrame:
    """Per backend: queries, top_1_hit_rate, top_3_hit_rate, mrr, median_query_ms, mean_output_tokens."""
    return rows.groupBy("backend").agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.coalesce(F.col("rank") == 1, F.lit(False)).cast("int")).alias("top_1_hit_rate"),
        F.avg(F.coalesce(F.col("rank") <= 3, F.lit(False)).cast("int")).alias("top_3_hit_rate"),
        F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
        F.median("query_ms").alias("median_query_ms"),
        F.avg("output_tokens").alias("mean_output_tokens"),
    )


def serialized(results: DataFrame, top: int = 3) -> DataFrame:
    """(hint_id, payload): the best clusters as compact JSON."""
    one = F.struct("rank", F.struct("confidence", "nodes").alias("c"))
    return (
        results.where(F.col("rank") <= top)
        .groupBy("hint_id")
        .agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"])).alias("payload"))
    )


def token_counts(rows: DataFrame, text: str, ranks_file: str, pattern: str, name: str = "output_tokens") -> DataFrame:
    """``rows`` with the number of tokens of a text by the vocabulary of a rank file that every executor can open; null has none."""
    columns = [c for c in rows.columns if c != name]
    at = columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            found = [len(encoding.encode_ordinary(x)) if x else 0 for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, name])

    return rows.select(*columns).mapInArrow(run, rows.select(*columns).withColumn(name, F.lit(0).cast("bigint")).schema)


def match_lines(output: DataFrame, prefix: str) -> DataFrame:
    """(path, line, text) of ``path:line:text`` rows, without the prefix, sorted; other rows go."""
    parsed = F.regexp_extract("value", r"^([^:]*):(\d+):(.*)$", 1)
    path = F.when(F.startswith(parsed, F.lit(prefix)), F.substring(parsed, len(prefix) + 1, 1 << 20)).otherwise(parsed)
    rows = output.where(F.col("value").rlike(r"^[^:]*:\d+:")).select(
        path.alias("path"), F.regexp_extract("value", r"^([^:]*):(\d+):(.*)$", 2).cast("int").alias("line"), F.trim(F.regexp_extract("value", r"^([^:]*):(\d+):(.*)$", 3)).alias("text")
    )
    return rows.orderBy("path", "line", "text")
