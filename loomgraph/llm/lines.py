"""Line dedup by site-relative frequency.

A line of a host is boilerplate when the share of the host's pages that hold
it exceeds a ratio.  Counts run over all pages; a page counts a line once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import materialise

#: Up to this many boilerplate lines (16 bytes each) go to the executors as a broadcast; more are joined by shuffle.
BROADCAST_LINES = 200_000


def _key(line: Column) -> Column:
    """What makes lines equal: the line without blanks at its ends.  64 bits; a clash matters only within one host's boilerplate."""
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def boilerplate_lines(docs: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """(host, line key, pages with it, pages of the host) for each line over the ratio.

    Each page gives the distinct keys of its lines and one null key, which counts the page itself, so
    one partial aggregation over (host, key) gives both counts and no key or host gathers raw rows.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: ~_blank(x))
    keys = F.array_distinct(F.transform(lines, _key))
    counted = (
        docs.select(host.alias("__h"), F.explode(F.concat(keys, F.array(F.lit(None).cast("bigint")))).alias("__k"))
        .groupBy("__h", "__k")
        .agg(F.count(F.lit(1)).alias("__n"))
        .where((F.col("__n") >= min_pages) | F.col("__k").isNull())
    )
    counted = materialise(counted, "line-counts")
    pages = counted.where(F.col("__k").isNull()).select("__h", F.col("__n").alias("__pages"))
    return counted.where(F.col("__k").isNotNull()).join(pages, "__h").where(F.col("__n") > ratio * F.col("__pages"))


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = 0.02,
    min_pages: int = 5,
) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and n_lines and n_dropped (lines that aren't blank).

    A line is dropped where more than ``ratio`` of its host's pages, and at least ``min_pages``, hold it.
    Every row stays, in any case: a text of boilerplate only becomes empty, null and empty texts stay as
    they are with 0 lines, blank lines are neither counted nor dropped, and repeated rows count as pages of
    their own.  A null host is the host ''.  Other columns pass through; an input column called n_lines or
    n_dropped is replaced.
    """
    site, body = F.coalesce(F.col(host).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    found = materialise(boilerplate_lines(docs, site, body, ratio, min_pages).select("__h", "__k"), "boilerplate")
    # A host has at most (mean lines of its pages) / ratio such lines, as their page counts add up to no more than its lines.
    by_host = found.groupBy(F.col("__h")).agg(F.collect_list("__k").alias("__drop"))
    if found.count() <= BROADCAST_LINES:
        by_host = F.broadcast(by_host)
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    hit = lambda x: ~_blank(x) & F.array_contains(F.col("__drop"), _key(x))
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    out = docs.select(*columns, site.alias("__site")).join(by_host, F.col("__site") == F.col("__h"), "left")
    out = out.withColumn("__lines", split).withColumn(
        "__kept", F.when(F.col("__drop").isNotNull(), F.filter("__lines", lambda x: ~hit(x)))
    )
    cut = F.col("__kept").isNotNull() & (F.size("__kept") < F.size("__lines"))
    return out.select(
        *[F.when(cut, F.array_join("__kept", "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in columns],
        F.size(F.filter("__lines", lambda x: ~_blank(x))).cast("bigint").alias("n_lines"),
        F.when(cut, F.size("__lines") - F.size("__kept")).otherwise(0).cast("bigint").alias("n_dropped"),
    )


def sql(ratio: float = 0.02, min_pages: int = 5) -> str:
    return f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS h, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
n AS (SELECT h, key, count(DISTINCT doc_id) AS n FROM t WHERE key <> '' GROUP BY 1, 2),
p AS (SELECT coalesce(source, '') AS h, count(*) AS pages FROM documents GROUP BY 1),
b AS (SELECT h, key FROM n JOIN p USING (h) WHERE n >= {min_pages} AND n > {ratio} * pages),
m AS (SELECT t.*, b.key IS NOT NULL AS hit FROM t LEFT JOIN b USING (h, key))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS text,
       count(*) FILTER (key <> '') AS n_lines, count(*) FILTER (hit) AS n_dropped
FROM m GROUP BY doc_id"""
