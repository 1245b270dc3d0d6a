"""The queries over whole tables, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, language_model, licenses, lines, mixing, ngram_join, quality_model, quality_rules, token_counts, warc
from loomgraph.llm.common import crc_bucket, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, mixing.document_dims(docs), mixing.n_words(docs["text"]))
    return out.select("doc_id", "mix_tokens", "mix_rate", "mix_copies", "mix_error")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    out = quality_model.score(docs.select("doc_id", "text"), model)
    predicted = (F.col("score") >= quality_model.THRESHOLD).cast("int")
    return out.select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", predicted.alias("predicted"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.drop("lang")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_edited(docs.withColumn("edits", token_counts.sample_edits(F.col("doc_id"), F.col("text"))))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(table(spark, sf_dir, "pages"))
    merged = warc.merge_runs(warc.read_archive(spark, path))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_decontaminate": op2_decontaminate,
        "op3_license_scan": op3_license_scan,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality_model": op5_quality_model,
        "op6_quality_rules": op6_quality_rules,
        "op7_ngram_join": op7_ngram_join,
        "op8_language_model": op8_language_model,
        "op9_token_counts": op9_token_counts,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.sql(),
        "op2_decontaminate": decontamination.sql(),
        "op3_license_scan": licenses.sql(),
        "op4_line_dedup": lines.sql(),
        "op7_ngram_join": ngram_join.sql(),
        "op10_warc": warc.sql(),
    }
