"""Hints against nodes: what a hint asks for and which nodes answer it.  Many hints are answered at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scores as S
from loomgraph.functions.tokens import split_tokens
from loomgraph.operators.scratch import dealt, few

LEAST, MOST_ANCHORS, MOST_FALLBACK = 0.15, 30, 10


def service_tokens(nodes: DataFrame) -> DataFrame:
    services = nodes.where(F.coalesce("service", F.lit("")) != "").select("service").distinct()
    return services.select(F.explode(split_tokens(F.col("service"))).alias("token")).distinct()


def effective_hints(hints: DataFrame, nodes: DataFrame) -> DataFrame:
    """``hints`` with hint_tokens: their tokens without those of service names, unless none is left."""
    own = F.array_distinct(split_tokens(F.coalesce("hint", F.lit(""))))
    each = hints.select("hint_id", F.explode(own).alias("token"))
    business = each.join(service_tokens(nodes), "token", "left_anti").groupBy("hint_id").agg(F.array_sort(F.collect_set("token")).alias("__b"))
    tokens = F.coalesce("__b", F.array_sort(own))
    return hints.join(business, "hint_id", "left").withColumn("hint_tokens", tokens).drop("__b")


def hint_scores(nodes: DataFrame, hints: DataFrame) -> DataFrame:
    """(hint_id, id, score, matches) of nodes that share a token with an effective hint; all others score 0."""
    keys = nodes.where(F.size("tokens") > 0).select("id", F.explode(F.array_union("tokens", "field_tokens")).alias("token"))
    met = hints.select("hint_id", F.explode("hint_tokens").alias("token")).join(keys, "token").select("hint_id", "id").distinct()
    many = not few(hints)
    asked = dealt(met, many).join(hints.select("hint_id", "hint_tokens"), "hint_id")
    both = dealt(asked, many).join(nodes.select("id", "tokens", "field_tokens"), "id")
    score = S.hint_score(F.col("hint_tokens"), F.col("tokens"), F.col("field_tokens"))
    matches = S.hint_matches(F.col("hint_tokens"), F.col("tokens"), F.col("field_tokens"))
    return both.select("hint_id", "id", score.alias("score"), matches.alias("matches"), F.size("hint_tokens").alias("n_hint"))


def find_anchors(nodes: DataFrame, hints: DataFrame, top_n: int = MOST_ANCHORS) -> DataFrame:
    """(hint_id, id, score, rank) of each hint's anchors, best first, ties by id.

    Where some node matches two tokens of a hint of several, nodes that match one are out.  Anchors score 0.15 or more;
    where none does, the ten best that score at all stand in.
    """
    per = Window.partitionBy("hint_id")
    scored = hint_scores(nodes, hints)
    strong = F.col("matches") >= 2
    scored = scored.withColumn("__s", F.max(F.when(F.col("n_hint") > 1, strong).otherwise(False)).over(per)).where(~F.col("__s") | strong)
    scored = scored.withColumn("__l", F.max("score").over(per) >= LEAST)
    ranked = scored.where("score > 0").withColumn("rank", F.row_number().over(per.orderBy(F.col("score").desc(), "id")))
    chosen = F.when(F.col("__l"), (F.col("score") >= LEAST) & (F.col("rank") <= top_n)).otherwise(F.col("rank") <= MOST_FALLBACK)
    return ranked.where(chosen).select("hint_id", "id", "score", "rank")
