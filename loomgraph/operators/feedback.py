"""Feedback on clusters: counted, inferred from what was opened, and used to rerank."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.scratch import dealt, few

ACCEPTED, REJECTED, MAX_AGE_DAYS, TTL_S = 0.15, 0.10, 90, 600


def recent(feedback: DataFrame, as_of: Column | dt.datetime, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Rows no older than that before ``as_of``, which stands for the clock."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return feedback.where(F.col("ts") >= at - F.expr(f"INTERVAL {max_age_days} DAYS"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """(hint, node_id, accepted, rejected) from the rows given; empty ids are passed over."""
    each = feedback.select("hint", "accepted", F.explode("node_ids").alias("node_id")).where("node_id <> ''")
    return each.groupBy("hint", "node_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def accepted_nodes(counts: DataFrame) -> DataFrame:
    return counts.where("accepted > 0").select("hint", "node_id")


def rerank(clusters: DataFrame, hints: DataFrame, counts: DataFrame) -> DataFrame:
    """Clusters with confidence and rank adjusted; without feedback on its nodes a cluster keeps both as far as others let it.

    Floored at 0, not capped, rounded to 6 places; equal confidences keep their order.
    """
    many = not few(clusters)
    each = dealt(clusters, many).join(hints.select("hint_id", "hint"), "hint_id").select("hint_id", "rank", "hint", F.explode("node_ids").alias("node_id"))
    shift = F.sum(F.col("accepted") * ACCEPTED - F.col("rejected") * REJECTED)
    moved = dealt(each, many).join(counts, ["hint", "node_id"]).groupBy("hint_id", "rank").agg(F.round(shift, 9).alias("shift"))
    joined = dealt(clusters, many).join(moved, ["hint_id", "rank"], "left")
    adjusted = F.when(F.coalesce("shift", F.lit(0.0)) != 0, F.round(F.greatest(F.lit(0.0), F.col("confidence") + F.col("shift")), 6)).otherwise(F.col("confidence"))
    out = joined.withColumn("confidence", adjusted).withColumnRenamed("rank", "prior_rank").drop("shift")
    best = Window.partitionBy("hint_id").orderBy(F.col("confidence").desc(), "prior_rank")
    return out.withColumn("rank", F.row_number().over(best))


def _buckets(at: Column, ttl_s: int) -> Column:
    """The stretch of ``ttl_s`` seconds that a time falls into."""
    return F.floor(F.unix_micros(at) / (ttl_s * 1_000_000)).cast("bigint")


def _within(rows: DataFrame, at: str, ttl_s: int) -> DataFrame:
    """Rows once for their own stretch and once for the next: what follows within the time to live falls into one of them."""
    first = _buckets(F.col(at), ttl_s)
    return rows.withColumn("__b", F.explode(F.array(first, first + 1)))


#: What a session waits for at most.
MOST_PENDING = 20


def implicit_feedback(queries: DataFrame, expands: DataFrame, ttl_s: int = TTL_S, most: int | None = MOST_PENDING) -> DataFrame:
    """Each query's first expand within the time to live that matches a node name of it, as a positive row.

    queries: (session, query_id, hint, ts, clusters array<struct<rank, node_names, node_ids>>); expands: (session, name, ts).
    Names match if either contains the other, in lower case; a query counts once, by its first matching cluster.  A session waits for
    its last 20 queries that haven't counted yet, as in the stream, whose steps are taken here too: over stretches of a session without a pause longer than the time to live, which
    know nothing of each other, in order of time and row by row.  With ``most`` None a session waits for all its queries.
    """
    if most is None:
        return first_matches(queries, expands, ttl_s)
    q = queries.select("session", F.lit("query").alias("kind"), "ts", "query_id", "hint", F.lit(None).cast("string").alias("name"), F.col("clusters").cast(CLUSTERS).alias("clusters"))
    e = expands.select("session", F.lit("expand").alias("kind"), "ts", F.lit(None).cast("bigint").alias("query_id"), F.lit(None).cast("string").alias("hint"), "name", F.lit(None).cast(CLUSTERS).alias("clusters"))
    rows = q.unionByName(e).where("ts IS NOT NULL AND session IS NOT NULL")
    own = Window.partitionBy("session").orderBy("ts")
    pause = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(own)) > ttl_s * 1_000_000
    rows = rows.withColumn("__pause", F.coalesce(pause.cast("int"), F.lit(0)))
    rows = rows.withColumn("__stretch", F.sum("__pause").over(own.rangeBetween(Window.unboundedPreceding, 0))).drop("__pause")
    order = ["session", "__stretch", "ts", F.when(F.col("kind") == "query", 0).otherwise(1), "query_id", "name"]
    dealt = rows.repartition("session", "__stretch").sortWithinPartitions(*order)
    found = dealt.mapInArrow(pending_steps(ttl_s, most), IMPLICIT)
    return found.select("ts", "hint", "cluster_rank", "node_ids", F.lit(True).alias("accepted"), F.lit("implicit_expand").alias("source"), "session", "query_id")


def first_matches(queries: DataFrame, expands: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """``implicit_feedback`` where every query waits its whole time, so that queries don't depend on each other.

    Within a stretch of time each different list of clusters meets each different name once; the next match of a query is then the
    last one before it where a stretch's rows run backwards.  Of expands at one moment that with the least query_id, if they have any, comes first.
    """
    number = F.col("query_id") if "query_id" in expands.columns else F.lit(None)
    shown = F.coalesce(F.col("clusters").cast(CLUSTERS), F.array().cast(CLUSTERS))
    q = queries.where("ts IS NOT NULL AND session IS NOT NULL").withColumns({"clusters": shown, "__b": _buckets(F.col("ts"), ttl_s)}).withColumn("__key", F.sha2(F.to_json("clusters"), 256))
    e = expands.where("ts IS NOT NULL AND session IS NOT NULL").select("session", "ts", number.cast("bigint").alias("__e"), F.coalesce("name", F.lit("")).alias("name"))
    e = e.withColumn("__b", F.explode(F.array(_buckets(F.col("ts"), ttl_s), _buckets(F.col("ts"), ttl_s) - 1)))
    low = F.lower("name")
    hits = F.filter("clusters", lambda c: F.exists(c["node_names"], lambda n: F.contains(F.lower(n), low) | F.contains(low, F.lower(n))))
    lists = q.groupBy("session", "__b", "__key").agg(F.first("clusters").alias("clusters"))
    met = lists.join(e.select("session", "__b", "name").distinct(), ["session", "__b"]).withColumn("__hit", F.get(hits, F.lit(0))).where("__hit IS NOT NULL")
    opened = e.join(met.select("session", "__b", "__key", "name", "__hit"), ["session", "__b", "name"])
    opened = opened.select("session", "__b", "__key", "ts", "__e", "name", F.lit(1).alias("__opens"), F.lit(None).cast("bigint").alias("query_id"), F.lit(None).cast("string").alias("hint"), F.struct("ts", F.col("__hit.rank").alias("rank"), F.col("__hit.node_ids").alias("node_ids")).alias("__next"))
    asked = q.select("session", "__b", "__key", "ts", F.lit(None).cast("bigint").alias("__e"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("__opens"), "query_id", "hint", F.lit(None).cast(opened.schema["__next"].dataType).alias("__next"))
    backwards = Window.partitionBy("session", "__b", "__key").orderBy(F.desc("ts"), F.desc("__opens"), F.desc("__e"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(opened).withColumn("__next", F.last("__next", ignorenulls=True).over(backwards))
    found = found.where((F.col("__opens") == 0) & (F.unix_micros("__next.ts") - F.unix_micros("ts") <= ttl_s * 1_000_000))
    return found.select(
        F.col("__next.ts").alias("ts"), "hint", F.col("__next.rank").alias("cluster_rank"), F.col("__next.node_ids").alias("node_ids"),
        F.lit(True).alias("accepted"), F.lit("implicit_expand").alias("source"), "session", "query_id",
    )


def rating_nodes(ratings: DataFrame, queries: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """Ratings with the node ids of the session's latest query with the same hint that had the rated rank, within the time to live.

    An as-of join backwards, by stretches of time; older queries stand in where newer ones have no such rank; without any the ids are empty.
    """
    asked = queries.select("session", "hint", F.col("ts").alias("asked"), "query_id", "clusters")
    pending = _within(asked, "asked", ttl_s).select("session", "hint", "asked", "query_id", "__b", F.explode("clusters").alias("c"))
    pending = pending.select("session", "hint", "__b", "asked", "query_id", F.col("c.rank").alias("cluster_rank"), F.col("c.node_ids").alias("node_ids"))
    soon = (F.col("asked") <= F.col("ts")) & (F.col("ts") <= F.col("asked") + F.expr(f"INTERVAL {ttl_s} SECONDS"))
    met = ratings.withColumn("__b", _buckets(F.col("ts"), ttl_s)).join(pending, ["session", "hint", "cluster_rank", "__b"]).where(soon)
    latest = met.groupBy("rating_id").agg(F.max_by("node_ids", F.struct("asked", "query_id")).alias("node_ids"))
    out = ratings.join(latest, "rating_id", "left")
    return out.withColumn("node_ids", F.coalesce("node_ids", F.array().cast("array<string>")))


# What a session goes through, row by row

CLUSTERS = "array<struct<rank:int,node_names:array<string>,node_ids:array<string>>>"
IMPLICIT = "session string, ts timestamp, query_id bigint, hint string, cluster_rank int, node_ids array<string>"


def matching_cluster(name: str, clusters: list[dict]) -> dict | None:
    """The first cluster with a node name that contains the opened name or is contained in it, in lower case."""
    low = name.lower()
    return next((c for c in clusters if any(low in n.lower() or n.lower() in low for n in c["node_names"])), None)


def step(waiting: list[tuple], row: Mapping, ttl_s: int, found: list[tuple], most: int = MOST_PENDING) -> list[tuple]:
    """What waits after a row; queries that it answers are added to ``found`` as (ts, query_id, hint, rank, node ids).

    ``waiting`` has (asked, query_id, hint, clusters), oldest first.
    """
    if row["kind"] == "query":
        return [*waiting, (row["ts"], row["query_id"], row["hint"], row["clusters"] or [])][-most:]
    left = []
    for entry in waiting:
        asked, query_id, hint, clusters = entry
        hit = matching_cluster(row["name"] or "", clusters) if 0 <= (row["ts"] - asked).total_seconds() <= ttl_s else None
        if hit:
            found.append((row["ts"], query_id, hint, hit["rank"], list(hit["node_ids"])))
        else:
            left.append(entry)
    return left


def pending_steps(ttl_s: int, most: int = MOST_PENDING):
    """Steps over rows that are sorted by session, stretch and time; what waits is all that is held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["session"], row["__stretch"]) != at:
                    at, waiting = (row["session"], row["__stretch"]), []
                found: list[tuple] = []
                waiting = step(waiting, row, ttl_s, found, most)
                out += [(row["session"], *f) for f in found]
            kinds = [pa.string(), batch.schema.field("ts").type, pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in IMPLICIT.split(", ")])

    return run
