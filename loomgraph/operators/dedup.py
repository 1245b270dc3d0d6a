"""Which of several rows with one key stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def last_wins(rows: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """An upsert: of the rows with one key the last stays."""
    return keep_one(rows, key, [F.col(seq).desc()])


def first_wins(rows: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    return keep_one(rows, key, [F.col(seq).asc()])


# Which role of a topic wins.
ROLE_PRIORITY = {"config": 0, "produce": 1, "consume": 2}


def priority_wins(topics: DataFrame, seq: str, role: str = "method") -> DataFrame:
    """One node per service and topic: config before produce before consume before others; then the first."""
    known = F.create_map(*[F.lit(x) for kv in ROLE_PRIORITY.items() for x in kv])
    priority = F.coalesce(F.element_at(known, F.coalesce(F.col(role), F.lit("consume"))), F.lit(9))
    return keep_one(topics, ["service", "raw_name"], [priority, F.col(seq)])
