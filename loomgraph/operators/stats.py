"""Counts and ages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_DAYS = 7


def stats(nodes: DataFrame) -> DataFrame:
    """(kind, value, n): nodes by type and by service in one pass."""
    sets = nodes.groupingSets([["type"], ["service"]], "type", "service").agg(F.count(F.lit(1)).alias("n"), F.grouping("type").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "type").otherwise("service").alias("kind"), F.when(F.col("g") == 0, F.col("type")).otherwise(F.col("service")).alias("value"), "n")


def services(nodes: DataFrame) -> DataFrame:
    return nodes.select("service").distinct()


def stale(repo_state: DataFrame, as_of: Column | dt.datetime, days: int = STALE_DAYS) -> DataFrame:
    """(oldest, age_days, warning): the warning is null while the oldest scan is younger than that many whole days."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    oldest = repo_state.agg(F.min("scanned_at").alias("oldest"))
    age = F.floor((F.unix_timestamp(at) - F.unix_timestamp("oldest")) / 86400)
    text = F.concat(F.lit("Oldest scan: "), age, F.lit(" days ago. Scan again."))
    return oldest.select("oldest", age.alias("age_days"), F.when(age >= days, text).alias("warning"))


def issue_activity(issues: DataFrame, maintainer: str, since: Column) -> DataFrame:
    """(total, external, maintainer, bot) of issues, not pull requests, created since then; bots first, then the maintainer."""
    bot = (F.col("user_type") == "Bot") | F.endswith("login", F.lit("[bot]"))
    kind = F.when(bot, "bot").when(F.lower("login") == maintainer.casefold(), "maintainer").otherwise("external")
    counted = issues.where(~F.col("is_pull_request") & (F.col("created_at") >= since)).withColumn("kind", kind)
    return counted.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("external", "maintainer", "bot")])
