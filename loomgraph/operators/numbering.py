"""Rows numbered in order, without bringing them to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.scratch import cut


def numbered(rows: DataFrame, order: str, name: str, start: int = 1) -> DataFrame:
    """``rows`` with ``name``, their place in the order of a column: each range of it counts its own rows, and starts where the ranges before it end."""
    ordered = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    ordered = cut(ordered, "numbered")
    part = F.shiftrightunsigned("__m", 33)
    sizes = ordered.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))  # one row a range
    before = F.sum("__c").over(Window.partitionBy(F.lit(0)).orderBy("__p")) - F.col("__c")
    starts = sizes.select("__p", before.alias("__b"))
    return ordered.join(F.broadcast(starts), part == F.col("__p")).withColumn(name, F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + start).drop("__m", "__p", "__b")
