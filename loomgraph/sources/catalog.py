"""Graphs, hints, feedback, judgments and source files made from business tables, whole tables each.

They give every operator input of its own shape that grows with the tables: each thousand parts name nodes of their own, one per name
and type, events are queries, expands and feedback on these nodes, and source text is rendered from brands and nations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.tokens import normalize
from loomgraph.operators.numbering import numbered

TYPES = [
    "graphql_query", "graphql_mutation", "graphql_subscription", "graphql_type", "http_endpoint", "kafka_topic",
    "frontend_query", "frontend_mutation", "frontend_rest", "backend_client_call", "cube_query",
]
VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH"]
KINDS = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]
BFF_SERVICES = ["svc-0", "svc-1", "svc-2"]


def _pick(values: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), n)


#: Parts, by key, whose words belong together; the words of others end otherwise.
PARTS_A_GROUP = 1000


def grown(part: DataFrame) -> DataFrame:
    """``part`` with p_group, letters for the part's group, names whose words end in them, and p_kind, the type in such a word."""
    letters = F.translate(F.floor(F.col("p_partkey") / PARTS_A_GROUP).cast("string"), "0123456789", "abcdefghij")
    words = [F.concat(F.split_part("p_name", F.lit(" "), F.lit(i)), letters) for i in (1, 2)]
    return part.withColumns({"p_name": F.concat_ws(" ", *words), "p_kind": F.concat(F.lower("p_type"), letters), "p_group": letters})


def by_group(places: DataFrame, name: str, parts: DataFrame) -> DataFrame:
    """Places once for each group of ``grown`` parts, with its letters behind their names."""
    return places.crossJoin(F.broadcast(parts.select("p_group").distinct())).withColumn(name, F.concat(name, "p_group")).drop("p_group")


def scanned_parts(part: DataFrame) -> DataFrame:
    """One scanned node per (p_name, p_type) of ``grown`` parts."""
    rows = part.groupBy("p_name", "p_type", "p_kind").agg(F.min("p_brand").alias("brand"))
    w1, w2 = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    t = F.array_position(F.array(*map(F.lit, KINDS)), F.col("p_type")).cast("int")
    rows = rows.select("*", w1.alias("w1"), w2.alias("w2"), t.alias("t"), F.ascii(w1).alias("a1"), F.ascii(w2).alias("a2"))
    kind = _pick(TYPES, (F.col("a1") + 2 * F.col("a2") + 3 * F.col("t")) % len(TYPES))
    rows = rows.withColumn("type", kind).withColumn("service", F.concat(F.lit("svc-"), (F.col("a2") + F.col("t")) % 5))
    calls = F.col("type").isin("http_endpoint", "frontend_rest", "backend_client_call")
    verb = _pick(VERBS, (F.length("p_name") + F.col("t")) % 5)
    method = F.when(calls, verb).when(F.col("type") == "kafka_topic", F.when(F.col("t") % 2 == 0, "produce").otherwise("consume"))
    rows = rows.withColumn("method", method)
    rows = rows.withColumn("path", F.when(calls, F.concat(F.lit("/"), "p_kind", F.lit("/{"), "w2", F.lit("Id}"))))
    rows = rows.withColumn("target_service", F.when(F.col("type") == "backend_client_call", F.concat(F.lit("svc-"), F.col("a1") % 5)))
    rows = rows.withColumn("raw_name", F.concat("w1", F.initcap("w2"), F.initcap("p_kind")))
    ident = F.concat_ws("::", "service", "type", F.coalesce("method", F.lit("-")), "raw_name")
    return rows.select(
        ident.alias("id"), "type", "raw_name", "service", F.concat(F.lit("src/"), "w1", F.lit("/"), "w2").alias("source_file"), "method", "path", "target_service",
        F.array(F.concat("w2", F.lit("Id")), F.concat("p_kind", F.lit("Code")), "brand").alias("fields"),
    )


def part_nodes(part: DataFrame) -> DataFrame:
    return normalize(scanned_parts(part))


def page_nodes(pages: DataFrame) -> DataFrame:
    """URLs as endpoints: the host is the service, the path names it."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    rows = pages.where(F.col("url").isNotNull()).select(
        F.concat(F.lit("page::"), F.col("page_id")).alias("id"), F.lit("http_endpoint").alias("type"), F.concat(host, path).alias("raw_name"), host.alias("service"),
        F.lit(None).cast("string").alias("source_file"), F.lit("GET").alias("method"), path.alias("path"), F.lit(None).cast("string").alias("target_service"),
        F.array().cast("array<string>").alias("fields"),
    )
    return normalize(rows)


def part_hints(part: DataFrame) -> DataFrame:
    """(hint_id, hint): every part name, every first word, and one with a service's name."""
    names = part.select(F.col("p_name").alias("hint")).distinct()
    words = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("hint")).distinct()
    one = part.agg(F.concat(F.lit("svc "), F.min(F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("hint")).where("hint IS NOT NULL")
    return numbered(names.union(words).union(one).distinct(), "hint", "hint_id").select("hint_id", "hint")


def node_numbers(nodes: DataFrame) -> DataFrame:
    """(n, id, raw_name): nodes by id, counted from 0."""
    return numbered(nodes.select("id", "raw_name"), "id", "n", 0).select("n", "id", "raw_name")


def event_feedback(events: DataFrame, nodes: DataFrame, hints: DataFrame) -> DataFrame:
    """Feedback rows: an event's hint and two nodes hang on its ids; errors reject, views say nothing."""
    ids = node_numbers(nodes)
    size = nodes.agg(F.count(F.lit(1)).alias("size"))
    asked = hints.agg(F.count(F.lit(1)).alias("asked"))
    rows = events.where("event_type <> 'view'").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(asked))
    rows = rows.withColumn("hint_id", F.col("event_id") % F.col("asked") + 1).withColumn("n", F.col("user_id") % F.col("size"))
    rows = rows.join(hints, "hint_id").join(ids, "n")
    other = ids.select(F.col("n").alias("m"), F.col("id").alias("id2"))
    rows = rows.withColumn("m", (F.col("user_id") * 7 + F.col("event_id")) % F.col("size")).join(other, "m")
    return rows.select(
        F.col("ts").cast("timestamp").alias("ts"), "hint", F.lit(1).alias("cluster_rank"), F.array("id", "id2").alias("node_ids"),
        (F.col("event_type") != "error").alias("accepted"), F.lit("manual").alias("source"),
    )


def event_activity(events: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries (views), expands (clicks) and ratings (purchases) of four teams; a query shows two clusters of one node each.

    What is asked for moves on with the hours over all nodes; the second node depends on the user.
    """
    size = nodes.agg(F.count(F.lit(1)).alias("size"))
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    rows = events.crossJoin(F.broadcast(size)).select(
        (F.col("user_id") % 4).cast("string").alias("session"), F.col("event_id").alias("query_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type",
        (hour * 7 % F.col("size")).alias("n1"), ((hour * 7 + F.col("user_id") % 3 + 1) % F.col("size")).alias("n2"),
    )
    ids = node_numbers(nodes)
    known = rows.join(ids.toDF("n1", "id1", "name1"), "n1").join(ids.toDF("n2", "id2", "name2"), "n2")

    def cluster(i: int) -> Column:
        return F.struct(F.lit(i).alias("rank"), F.array(F.lower(f"name{i}"), F.lower(f"id{i}")).alias("node_names"), F.array(f"id{i}").alias("node_ids"))

    queries = known.where("event_type = 'view'").select("session", "query_id", F.col("name1").alias("hint"), "ts", F.array(cluster(1), cluster(2)).alias("clusters"))
    expands = known.where("event_type = 'click'").select("session", F.col("name2").alias("name"), "ts", "query_id")
    rank = (F.col("query_id") % 2 + 1).cast("int").alias("cluster_rank")
    return queries, expands, known.where("event_type = 'purchase'").select(F.col("query_id").alias("rating_id"), "session", "ts", F.col("name1").alias("hint"), rank)


def part_judgments(part: DataFrame, nodes: DataFrame) -> DataFrame:
    """(judgment_id, hint, expected_node_ids, match, k): a part name should find the node of its first type."""
    stem = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))))
    named = part.select("p_name", stem.alias("stem")).distinct()
    # A node's name is the stem and one more word.
    ids = named.join(nodes.select("id", F.regexp_extract("raw_name", "^[a-z]+[A-Z][a-z]+", 0).alias("stem")), "stem").groupBy("p_name").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    every = F.when(F.col("judgment_id") % 3 == 0, "all").otherwise("any")
    rows = numbered(ids, "p_name", "judgment_id").withColumnRenamed("p_name", "hint")
    expected = F.when(F.col("judgment_id") % 3 == 0, F.slice("ids", 1, 2)).otherwise(F.slice("ids", 1, 1))
    return rows.select("judgment_id", "hint", expected.alias("expected_node_ids"), every.alias("match"), F.when(F.col("judgment_id") % 2 == 0, 3).cast("int").alias("k"))
