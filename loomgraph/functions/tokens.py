"""Identifiers as token arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_tokens(name: Column) -> Column:
    """Camel case, then - _ . / apart; lower case; tokens of one character go.  Digits and other signs split nothing."""
    spaced = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.split(F.regexp_replace(spaced, "[-_./]", " "), r"\s+")
    return F.transform(F.filter(parts, lambda t: F.length(t) > 1), F.lower)


def distinct_tokens(name: Column) -> Column:
    """Tokens of a name without repeats, in order; a null name has none."""
    return F.array_distinct(split_tokens(F.coalesce(name, F.lit(""))))


def fields_of(fields: Column, path: Column, target: Column) -> Column:
    """A node's fields with its path and target service, where they aren't empty."""
    more = F.filter(F.array(path, target), lambda x: x.isNotNull() & (x != ""))
    return F.concat(F.coalesce(fields, F.array().cast("array<string>")), more)


def field_tokens(fields: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(fields, lambda f: split_tokens(F.coalesce(f, F.lit(""))))))


def normalize(scanned: DataFrame) -> DataFrame:
    """Scanned nodes as graph nodes, with tokens and field_tokens in the place of fields."""
    fields = fields_of(F.col("fields"), F.col("path"), F.col("target_service"))
    kept = ["id", "type", "raw_name", "service", "source_file", "method", "path", "target_service"]
    return scanned.select(*kept, distinct_tokens(F.col("raw_name")).alias("tokens"), field_tokens(fields).alias("field_tokens"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def camel_to_kebab(name: Column) -> Column:
    return F.ltrim(F.lower(F.regexp_replace(name, "([A-Z])", "-$1")), F.lit("-"))


def path_variables(path: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(path, F.lit("")), F.lit(r"\{(\w+)\}"), 1)


def token_count_proxy(text: Column) -> Column:
    """Words and signs: a stand-in for a tokeniser's count where no vocabulary is at hand."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\w+|[^\w\s]"))


def string_list(json: Column) -> Column:
    """A JSON array of strings; null where it isn't one."""
    return F.from_json(json, "array<string>")


def parse_time(text: Column) -> Column:
    """ISO 8601, UTC where no zone is named; what can't be parsed is the epoch."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(F.lit(0)))
