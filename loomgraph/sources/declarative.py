"""Kafka topics: what is configured, by the lines of YAML files, joined with what code consumes and produces.

A scanner takes (service, path, text) and returns scanned nodes (see schema.SCANNED).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.tokens import camel_to_kebab
from loomgraph.operators.dedup import priority_wins
from loomgraph.schema import SCANNED
from loomgraph.sources.files import file_name
from loomgraph.sources.parsed import kafka_uses

def as_nodes(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with the columns of a scanned node; those not given are null."""
    return rows.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCANNED])


def joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def yaml_topics(files: DataFrame) -> DataFrame:
    """(service, path, key, topic) from application*.yaml: values under a key path that has kafka.topic.

    Each line's indentation places it; its parent is the nearest line above that is indented less.
    """
    named = files.where(file_name(F.col("path")).rlike(r"^application.*\.yaml$"))
    lines = named.select("service", "path", F.posexplode(F.split(_lines(F.col("text")), "\n")).alias("n", "line"))
    lines = lines.where(F.col("line").rlike(r"^\s*[\w.-]+\s*:")).select(
        "service", "path", "n", F.length(F.regexp_extract("line", r"^(\s*)", 1)).alias("depth"),
        F.regexp_extract("line", r"^\s*([\w.-]+)\s*:", 1).alias("key"),
        F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract("line", r":\s*(.*)$", 1), r"\s+#.*$", "")), "^[\"']|[\"']$", "").alias("value"),
    )
    # The stack of open keys at each line, kept by depth: a fold over one file's lines.
    stack = "array<struct<depth:int,key:string>>"
    files_ = lines.groupBy("service", "path").agg(F.array_sort(F.collect_list(F.struct("n", "depth", "key", "value"))).alias("ls"))
    start = F.struct(F.array().cast(stack).alias("open"), F.array().cast("array<struct<full:string,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        above = F.filter(acc["open"], lambda o: o["depth"] < x["depth"])
        opened = F.concat(above, F.array(F.struct(x["depth"].alias("depth"), x["key"].alias("key"))))
        full = F.array_join(F.transform(opened, lambda o: o["key"]), ".")
        return F.struct(opened.alias("open"), F.concat(acc["out"], F.array(F.struct(full.alias("full"), x["value"].alias("value")))).alias("out"))

    out = files_.select("service", "path", F.explode(F.aggregate("ls", start, step, lambda acc: acc["out"])).alias("x"))
    known = out.where(F.contains("x.full", F.lit("kafka.topic")) & (F.col("x.value") != ""))
    return known.select("service", "path", F.substring_index("x.full", ".", -1).alias("key"), F.col("x.value").alias("topic"))


def topic_lines(files: DataFrame) -> DataFrame:
    """(service, path, key, topic) by lines alone: what stands below an indented ``topic:`` up to the next line without indent."""
    named = files.where(file_name(F.col("path")).rlike(r"^application.*\.yaml$"))
    lines = named.select("service", "path", F.posexplode(F.split(_lines(F.col("text")), "\n")).alias("n", "line"))
    blank, word = F.substring("line", 1, 1).isin(" ", "\t"), F.trim(F.split_part("line", F.lit(":"), F.lit(1)))
    mark = F.when(blank & (word == "topic") & F.contains("line", F.lit("topic:")), 1).when((F.col("line") != "") & ~blank, 0)
    within = F.last(mark, ignorenulls=True).over(Window.partitionBy("service", "path").orderBy("n"))
    rest = F.substr("line", F.locate(":", F.col("line")) + 1)
    value = F.split_part(F.trim(rest), F.lit(" "), F.lit(1))
    inside = lines.withColumn("i", within).where((F.col("i") == 1) & blank & word.rlike(r"^\w+$") & F.startswith(rest, F.lit(" ")) & (value != ""))
    return inside.select("service", "path", word.alias("key"), value.alias("topic"))


def resolve_properties(references: DataFrame, topics: DataFrame) -> DataFrame:
    """``references`` (service, key, ...) with ``topic``: that of the service's property, or the key itself."""
    known = topics.groupBy("service", "key").agg(F.max_by("topic", "path").alias("__t"))
    return references.join(known, ["service", "key"], "left").withColumn("topic", F.coalesce("__t", "key")).drop("__t")


def scan_kafka(files: DataFrame) -> DataFrame:
    """Topics configured, consumed and produced; one node per service and topic, config before produce before consume."""
    topics = yaml_topics(files)
    uses = kafka_uses(files)
    known = topics.groupBy("service", "key").agg(F.max_by("topic", "path").alias("__t"))
    # A listener's unknown property is its key, a producer's the key in kebab case.
    unknown = F.when(F.col("role") == "produce", camel_to_kebab(F.col("key"))).otherwise(F.col("key"))
    used = uses.join(known, ["service", "key"], "left").withColumn("topic", F.when(F.col("ref"), F.coalesce("__t", unknown)).otherwise(F.col("key")))
    set_up = topics.select("service", "path", "topic", F.array("key").alias("fields"), F.lit("config").alias("role"))
    every = set_up.unionByName(used.select("service", "path", "topic", "fields", "role"))
    nodes = as_nodes(
        every,
        id=joined(F.col("service"), "::kafka::", F.col("role"), "::", F.col("topic")),
        type=F.lit("kafka_topic"),
        raw_name=F.col("topic"),
        service=F.col("service"),
        source_file=F.col("path"),
        fields=F.concat("fields", F.array("role")),
        method=F.col("role"),
    )
    return priority_wins(nodes.withColumn("__seq", F.struct("source_file", "id")), "__seq").drop("__seq")
