"""Hints to ranked, trimmed clusters; names to neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scores as S
from loomgraph.operators import anchors as A
from loomgraph.operators import clusters as C
from loomgraph.operators import feedback as B
from loomgraph.operators.scratch import cut, dealt, few
from loomgraph.operators.similarity import adjacency
from loomgraph.operators.substrings import contained

PER_BUCKET, MOST_SHOWN, SUMMARY_FLOOR, EXPAND_FLOOR, MOST_TARGETS, MOST_NEIGHBORS = 2, 12, 0.12, 0.08, 3, 10


def strong_nodes(clusters: DataFrame, nodes: DataFrame, hints: DataFrame) -> DataFrame:
    """For hints of several tokens only nodes that match two, where at least two do."""
    each = clusters.select("hint_id", "rank", F.posexplode("node_ids").alias("pos", "id"))
    many = not few(clusters)
    known = dealt(each, many).join(nodes.select("id", "tokens", "field_tokens"), "id")
    known = dealt(known, many).join(hints.select("hint_id", "hint_tokens"), "hint_id")
    strong = (F.size("hint_tokens") > 1) & (S.hint_matches(F.col("hint_tokens"), F.col("tokens"), F.col("field_tokens")) >= 2)
    n = F.count_if("strong").over(Window.partitionBy("hint_id", "rank"))
    kept = known.withColumn("strong", strong).withColumn("n", n).where("strong OR n < 2")
    back = kept.groupBy("hint_id", "rank").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
    return dealt(clusters.drop("node_ids"), many).join(back, ["hint_id", "rank"]).withColumn("node_ids", F.transform("x", lambda s: s["id"])).drop("x")


def distinct_sets(clusters: DataFrame) -> DataFrame:
    """The first of a hint's clusters with equal node sets."""
    same = Window.partitionBy("hint_id", F.array_sort("node_ids")).orderBy("rank")
    return clusters.withColumn("__n", F.row_number().over(same)).where("__n = 1").drop("__n")


def trim(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hint_id, rank, confidence, pos, id, type, service, raw_name, label): two of a service and type, twelve in all."""
    each = clusters.select("hint_id", "rank", "confidence", F.posexplode("node_ids").alias("at", "id"))
    known = dealt(each, not few(clusters)).join(nodes.select("id", "type", "service", "raw_name", "method", "path"), "id")
    bucket = Window.partitionBy("hint_id", "rank", "service", "type").orderBy("at")
    shown = known.withColumn("__b", F.row_number().over(bucket)).where(F.col("__b") <= PER_BUCKET)
    shown = shown.withColumn("pos", F.row_number().over(Window.partitionBy("hint_id", "rank").orderBy("at"))).where(F.col("pos") <= MOST_SHOWN)
    label = S.node_label(F.col("type"), F.col("method"), F.col("path"))
    return shown.select("hint_id", "rank", "confidence", "pos", "id", "type", "service", "raw_name", label.alias("label"))


def directed_summary(shown: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hint_id, rank, from_service, to_service, from_node, to_node, score): the best edge of each direction between shown nodes."""
    known = edges.where((F.col("total_score") >= SUMMARY_FLOOR) & F.col("from_service").isNotNull() & F.col("to_service").isNotNull())
    known = known.select("source_id", "target_id", "total_score", "from_service", "to_service")
    member = shown.groupBy("hint_id", "rank").agg(F.collect_set("id").alias("ids"))
    pairs = member.select("hint_id", "rank", F.explode(C.pairs_within("ids", "ids")).alias("p")).select("hint_id", "rank", "p.*")
    many = not few(shown)
    inside = dealt(pairs, many).join(known, ["source_id", "target_id"]).withColumn("score", S.shown_score(F.col("total_score")))
    best = Window.partitionBy("hint_id", "rank", "from_service", "to_service").orderBy(F.col("score").desc(), F.col("total_score").desc(), "source_id", "target_id")
    first = inside.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    names = nodes.select("id", "raw_name")
    first = dealt(first, many).join(names.toDF("source_id", "from_node"), "source_id")
    first = dealt(first, many).join(names.toDF("target_id", "to_node"), "target_id")
    return first.select("hint_id", "rank", "from_service", "to_service", "from_node", "to_node", "score")


def ranked_clusters(nodes: DataFrame, edges: DataFrame, hints: DataFrame, top_n: int = 5, feedback: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Clusters per hint before enrichment, and the hints with their effective tokens."""
    asked = cut(A.effective_hints(hints, nodes), "asked")
    found = C.build_clusters(nodes, edges, cut(A.find_anchors(nodes, asked), "anchors"), asked, top_n)
    if feedback is not None:
        found = B.rerank(cut(found, "clusters"), hints, B.feedback_counts(feedback)).drop("prior_rank")
    return cut(found, "clusters"), asked


def query(nodes: DataFrame, edges: DataFrame, hints: DataFrame, top_n: int = 5, feedback: DataFrame | None = None) -> DataFrame:
    """(hint_id, query, rank, confidence, nodes, services, directed_edges): the answer to every hint in one plan.

    ``hints`` is (hint_id, hint); ``feedback`` the rows to rerank by, already cut to their age.
    """
    found, asked = ranked_clusters(nodes, edges, hints, top_n, feedback)
    shown = cut(trim(distinct_sets(cut(strong_nodes(found, nodes, asked), "strong")), nodes), "shown")
    many = not few(shown)
    order = F.struct("pos", "type", "label", F.col("raw_name").alias("name"), "service", "id")
    grouped = shown.groupBy("hint_id", "rank").agg(
        F.first("confidence").alias("confidence"),
        F.array_sort(F.collect_list(order)).alias("nodes"),
        F.array_sort(F.collect_set("service")).alias("services"),
    )
    way = F.struct((-F.col("score")).alias("o"), "from_service", "to_service", "from_node", "to_node", "score")
    ways = directed_summary(shown, edges, nodes).groupBy("hint_id", "rank").agg(F.array_sort(F.collect_list(way)).alias("directed_edges"))
    told = dealt(grouped, many).join(ways, ["hint_id", "rank"], "left")
    out = dealt(told, many).join(hints.select("hint_id", F.col("hint").alias("query")), "hint_id")
    place = F.row_number().over(Window.partitionBy("hint_id").orderBy("rank"))
    bare = F.coalesce(F.transform("directed_edges", lambda e: e.dropFields("o")), F.array())
    return out.select("hint_id", "query", place.alias("rank"), "confidence", F.transform("nodes", lambda n: n.dropFields("pos")).alias("nodes"), "services", bare.alias("directed_edges"))


def expand(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, source_id, neighbor_id, label, score, from_service, to_service, direction, rank): up to ten neighbours of up to three nodes.

    ``names`` is (name); a node matches if its id or name contains it in lower case.  Each node is walked once for all names.
    """
    met = contained(nodes.select("id", "raw_name", "service"), [F.lower("id"), F.lower("raw_name")], names.select("name"), F.lower("name"))
    first = met.withColumn("__n", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("__n") <= MOST_TARGETS)
    source = cut(first.select("name", "id", F.col("service").alias("__s")), "sources")
    ends = edges.where(F.col("total_score") >= EXPAND_FLOOR).select("source_id", "target_id", F.col("total_score").alias("score"), "from_service", "to_service")
    near = ends.withColumnsRenamed({"source_id": "id", "target_id": "neighbor_id"}).unionByName(ends.withColumnsRenamed({"target_id": "id", "source_id": "neighbor_id"}))
    top = source.join(C.best_neighbors(near, source, MOST_NEIGHBORS), "id")
    top = top.withColumnsRenamed({"id": "source_id", "neighbor_id": "other", "score": "total_score", "__n": "rank"})
    named = top.join(nodes.select(F.col("id").alias("other"), "type", "method", "path"), "other")
    way = S.direction_label(F.col("from_service"), F.col("to_service"), F.col("__s"))
    label = S.node_label(F.col("type"), F.col("method"), F.col("path"))
    return named.select(
        "name", "source_id", F.col("other").alias("neighbor_id"), label.alias("label"), S.shown_score(F.col("total_score")).alias("score"),
        "from_service", "to_service", way.alias("direction"), "rank",
    )


def edges_of(edges: DataFrame, ids: DataFrame, floor: float) -> DataFrame:
    """Edges of a score with an end among the ids: each edge is looked up by either end and stays one row."""
    known, strong = ids.select("id").distinct(), edges.where(F.col("total_score") >= floor)
    for c in ("source_id", "target_id"):
        strong = strong.join(known.select(F.col("id").alias(c), F.lit(True).alias(f"__{c}")), c, "left")
    return strong.where("__source_id OR __target_id").select(*edges.columns)


def where_service(nodes: DataFrame, service: str | Column) -> DataFrame:
    return nodes.where(F.col("service") == service)


__all__ = ["adjacency", "directed_summary", "distinct_sets", "edges_of", "expand", "query", "ranked_clusters", "strong_nodes", "trim", "where_service"]
