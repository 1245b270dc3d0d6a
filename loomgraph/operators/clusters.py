"""Neighbourhoods of anchors, merged and scored as clusters.

A hint has at most 30 anchors of at most 12 nodes each, so the two order-dependent steps are folds
over bounded arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scores as S
from loomgraph.operators.scratch import cut, dealt, few
from loomgraph.operators.similarity import adjacency, degrees

HOOD_FLOOR, MOST_MEMBERS, MERGE, SAME, LEAST_MEMBERS = 0.25, 12, 0.25, 0.7, 2


def neighborhoods(anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """(hint_id, rank, id, hood): an anchor with its best neighbours, 12 nodes at most, as a sorted array.

    A node's neighbourhood is the same for all hints, so it is made once and before the hints are met.
    """
    near = adjacency(edges.where(F.col("total_score") >= HOOD_FLOOR)).where("neighbor_id <> id")
    grouped = best_neighbors(near, anchors, MOST_MEMBERS - 1).groupBy("id").agg(F.collect_list("neighbor_id").alias("__h"))
    hood = F.array_sort(F.array_union(F.array("id"), F.coalesce("__h", F.array().cast("array<string>"))))
    asked = dealt(anchors.select("hint_id", "rank", "id"), not few(anchors))
    return asked.join(grouped, "id", "left").select("hint_id", "rank", "id", hood.alias("hood"))


def best_neighbors(near: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """The ``most`` best rows of ``near`` (id, neighbor_id, score, ..) of each id, with their place __n; ids that aren't asked for may be among them.

    The best are taken where the rows lie, and again where a node's rows come together; for few ids only theirs are looked at.
    """
    if few(ids):
        near = near.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")
    best = Window.partitionBy("id").orderBy(F.col("score").desc(), "neighbor_id")
    return near.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= most)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def hood_overlaps(hoods: DataFrame, least: float = MERGE) -> DataFrame:
    """(hint_id, a, b, overlap) of a hint's anchors a before b whose hoods overlap, compared within the hint's few hoods."""
    ordered = hoods.groupBy("hint_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hood"))).alias("hoods"))
    each = ordered.select("hint_id", "hoods", F.posexplode("hoods").alias("__i", "x"))
    later = F.slice("hoods", F.col("__i") + 2, F.greatest(F.size("hoods"), F.lit(1)))
    pairs = F.transform(later, lambda y: F.struct(y["rank"].alias("b"), overlap(F.col("x.hood"), y["hood"]).alias("overlap")))
    out = each.select("hint_id", F.col("x.rank").alias("a"), F.explode(pairs).alias("y")).select("hint_id", "a", "y.b", "y.overlap")
    return out.where((F.col("overlap") >= least) & (F.col("overlap") > 0))


_GROUP = "array<struct<seed:int,hood:array<string>,members:array<string>>>"


def merge_hoods(hoods: DataFrame) -> DataFrame:
    """(hint_id, seed, members): each anchor in rank order joins the first seed whose own hood overlaps its hood, or is a seed."""
    ordered = hoods.groupBy("hint_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hood"))).alias("hoods"))

    def step(acc: Column, h: Column) -> Column:
        places = F.transform(acc, lambda g, i: F.when(overlap(g["hood"], h["hood"]) >= MERGE, i))
        at = F.array_min(places)
        seed = F.struct(h["rank"].alias("seed"), h["hood"].alias("hood"), h["hood"].alias("members"))
        grown = F.transform(
            acc,
            lambda g, i: F.struct(
                g["seed"].alias("seed"), g["hood"].alias("hood"), F.when(i == at, F.array_union(g["members"], h["hood"])).otherwise(g["members"]).alias("members")
            ),
        )
        return F.when(at.isNull(), F.concat(acc, F.array(seed))).otherwise(grown)

    groups = ordered.select("hint_id", F.aggregate("hoods", F.array().cast(_GROUP), step).alias("groups"))
    return groups.select("hint_id", F.explode("groups").alias("g")).select("hint_id", F.col("g.seed").alias("seed"), F.array_sort("g.members").alias("members"))


def drop_repeats(groups: DataFrame) -> DataFrame:
    """Groups in seed order without those that mostly repeat an earlier one that stayed, and without single nodes.

    What stays is remembered before its size is looked at.
    """
    kind = "array<struct<seed:int,members:array<string>>>"
    ordered = groups.groupBy("hint_id").agg(F.array_sort(F.collect_list(F.struct("seed", "members"))).alias("all"))
    kept = F.aggregate(
        "all", F.array().cast(kind), lambda acc, g: F.when(F.exists(acc, lambda k: overlap(k["members"], g["members"]) >= SAME), acc).otherwise(F.concat(acc, F.array(g)))
    )
    out = ordered.select("hint_id", F.explode(kept).alias("g")).select("hint_id", "g.seed", "g.members")
    return out.where(F.size("members") >= LEAST_MEMBERS)


def pairs_within(members: str, first: str) -> Column:
    """Pairs, as edges have them, of different ids of an array that aren't both outside of another array of some of them; each once."""

    def of(a: Column) -> Column:
        others = F.filter(members, lambda m: (m != a) & ~((m < a) & F.array_contains(first, m)))
        return F.transform(others, lambda m: F.struct(F.least(a, m).alias("source_id"), F.greatest(a, m).alias("target_id")))

    return F.flatten(F.transform(first, of))


def score_clusters(groups: DataFrame, nodes: DataFrame, edges: DataFrame, anchors: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``groups`` with node_ids in their final order and confidence.

    The mean runs over edges of 0.25 or more within the cluster that touch an anchor of the hint.
    """
    many = not few(groups)
    member = groups.select("hint_id", "seed", F.explode("members").alias("id"))
    strong = edges.where(F.col("total_score") >= HOOD_FLOOR).select("source_id", "target_id", "total_score")
    ends = anchors.groupBy("hint_id").agg(F.collect_set("id").alias("__a"))
    touched = dealt(groups, many).join(ends, "hint_id").withColumn("__a", F.array_intersect("members", "__a"))
    pairs = touched.select("hint_id", "seed", F.explode(pairs_within("members", "__a")).alias("p")).select("hint_id", "seed", "p.*")
    inside = dealt(pairs, many).join(strong, ["source_id", "target_id"])
    means = inside.groupBy("hint_id", "seed").agg(F.avg("total_score").alias("mean"))
    known = dealt(member, many).join(nodes.select("id", "type", "service", "tokens", "field_tokens"), "id")
    known = dealt(known, many).join(anchors.select("hint_id", "id", "rank"), ["hint_id", "id"], "left")
    aggs = [
        F.count_distinct("type").alias("n_types"),
        F.count_distinct("service").alias("n_services"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("rank", F.lit(2**30)).alias("r"), "id"))).alias("__ids"),
        F.count(F.lit(1)).alias("n"),
    ]
    if hints is not None:
        known = dealt(known, many).join(hints.select("hint_id", "hint_tokens"), "hint_id")
        aggs += [
            F.array_distinct(F.flatten(F.collect_list(F.array_union("tokens", "field_tokens")))).alias("__tokens"),
            F.max(S.hint_score(F.col("hint_tokens"), F.col("tokens"), F.col("field_tokens"))).alias("relevance"),
            F.count_if(F.arrays_overlap("hint_tokens", "tokens")).alias("direct"),
            F.first("hint_tokens").alias("hint_tokens"),
        ]
    found = dealt(known.groupBy("hint_id", "seed").agg(*aggs), many).join(means, ["hint_id", "seed"], "left")
    found = found.withColumn("confidence", S.cluster_confidence(F.coalesce("mean", F.lit(0.0)), F.col("n_types"), F.col("n_services")))
    if hints is not None:
        coverage = F.size(F.array_intersect("hint_tokens", "__tokens")) / F.greatest(F.size("hint_tokens"), F.lit(1))
        found = found.withColumn("confidence", S.hint_confidence(F.col("confidence"), coverage, F.col("relevance"), F.col("direct") / F.col("n")))
    return found.select("hint_id", "seed", F.transform("__ids", lambda x: x["id"]).alias("node_ids"), "confidence")


def build_clusters(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, hints: DataFrame | None = None, top_n: int = 5) -> DataFrame:
    """(hint_id, rank, confidence, node_ids) of each hint's best clusters."""
    groups = cut(drop_repeats(merge_hoods(neighborhoods(anchors, edges))), "groups")
    scored = score_clusters(groups, nodes, edges, anchors, hints)
    best = Window.partitionBy("hint_id").orderBy(F.col("confidence").desc(), "node_ids")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n).select("hint_id", "rank", "confidence", "node_ids")


def degree_anchors(nodes: DataFrame, edges: DataFrame, top_n: int = 20) -> DataFrame:
    """Without a hint the nodes with most neighbours are the anchors, ties by id, under the hint_id 0."""
    ranked = nodes.select("id").join(degrees(edges.where("total_score >= 0.12")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
    top = ranked.orderBy(F.col("degree").desc(), "id").limit(top_n)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("degree").desc(), "id"))
    return top.select(F.lit(0).cast("bigint").alias("hint_id"), "id", F.lit(None).cast("double").alias("score"), rank.alias("rank"))
