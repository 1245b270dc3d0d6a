"""From raw documents to a training mixture, in five stages.

Each stage takes the documents that the one before it kept.  All but the last return
the columns of ``documents``; the last adds the mixture's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, lines, mixing, ngram_join, quality_model
from loomgraph.llm.common import BROADCAST_KEYS, materialise, table, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a quality score of the threshold or more.

    Null and empty texts are scored like any other; equal texts have equal scores, so repeated rows stay or go together.
    """
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model, name="__score")
    return scored.where(F.col("__score") >= quality_model.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts boilerplate lines of each source; n_chars follows the text, and every document stays.

    Null and empty texts stay as they are; a text of boilerplate only becomes empty.  Input columns called n_lines or n_dropped stay.
    """
    names = {c: f"__own_{c}" for c in docs.columns if c in ("n_lines", "n_dropped")}
    cut = lines.drop_boilerplate(docs.withColumnsRenamed(names))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return cut.drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in names.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more: that with the smallest id.

    Null ids come last.  Unlike texts under one id, or under none, are documents of their own; of rows with equal ids and texts
    the one that sorts first stays.  Null texts, and texts without words, are near to nothing.
    """
    # Rows whose id is null or repeated, few if any, are told apart by id and text; their keys are negative.
    again = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__again")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__again")
    again = materialise(again, "repeated-ids")
    few = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    own = F.xxhash64("doc_id", "text")
    shared = F.col("doc_id").isNull() | (F.col("doc_id") < 0) | F.col("__again").isNotNull()
    keyed = docs.join(few, F.col("doc_id") == F.col("__again"), "left").withColumn("__key", F.when(shared, -F.abs(F.shiftright(own, 1)) - 1).otherwise(F.col("doc_id"))).drop("__again")
    found = ngram_join.near_duplicates(keyed, n=5, pct=80, doc_id="__key").select("__key", "component_id")
    found = materialise(found.distinct(), "components")
    if keyed.where("__key < 0").isEmpty():
        return without(keyed, found.where("__key <> component_id"), "__key").select(*docs.columns)
    # Some keys are negative: the smallest id of each component is looked up, then the first of equal rows.
    named = keyed.select("__key", "doc_id").join(found, "__key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))["__key"].alias("__first"))
    kept = without(keyed, named.join(first, "component_id").where("__key <> __first"), "__key")
    single = kept.where("__key >= 0").select(*docs.columns)
    order = Window.partitionBy("__key", "text").orderBy(*docs.columns)
    return single.unionByName(kept.where("__key < 0").withColumn("__k", F.row_number().over(order)).where("__k = 1").select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a window of a benchmark item, or all its words near each other.

    Rows are told apart by id and text, so equal rows stay or go together; null and empty texts hold nothing and stay.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    index = materialise(decontamination.build_index(keyed, doc_id="__key"), "index")
    found = decontamination.search(index, table(spark, sf_dir, "benchmark"), slack=decontamination.SLACK)
    return without(keyed, found.where((F.size("items") > 0) | (F.size("near") > 0)).select(F.col("doc_id").alias("__key")), "__key").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mixture; mix_copies says how often a document goes into training.

    A document with a null or unlisted source is drawn at the rate of '*'; one without words at that of its stratum.  Equal ids are drawn together.
    """
    return mixing.mix(docs, mixing.document_dims(docs), mixing.n_words(docs["text"])).where("mix_copies > 0")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]
#: SQL can't express the classifier; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
