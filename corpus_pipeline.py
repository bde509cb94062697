"""From raw documents to a training mix: quality, repeated lines, near duplicates, leaked benchmark items, source weights.

Every stage works on all rows that its predecessor kept, which are written as Parquet and read again in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlens.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from commentlens.llm.common import shared_folder, table, words

#: Words that a document must keep when lines are cut from it.
MIN_WORDS = 10


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the list learned from labels rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; n_chars is that of what is left.

    Documents that this leaves with fewer than ``MIN_WORDS`` words go: what they had is in others. Untouched ones all stay.
    """
    left = line_dedup.drop_recurring_lines(docs)
    left = left.where((F.col("n_dropped") == 0) | (F.size(words(F.col("text"))) >= MIN_WORDS)).select(docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id (null last; ties by a hash of the text), once.

    A document is a doc_id with a text: rows that share a doc_id but not their text are judged apart, and so are rows without
    doc_id. Of rows equal in both, one stays. Documents without words are in no group.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    groups = ngram_join.jaccard_components(docs.select(key.alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "component_id")
    ids = docs.select(key.alias("__key"), F.col("doc_id").cast("long").alias("__id")).distinct()
    order = F.struct(F.col("__id").isNull(), "__id", "__key")
    best = groups.distinct().join(ids, "__key").groupBy("component_id").agg(F.min_by("__key", order).alias("__key")).select("__key")
    kept = docs.withColumn("__row", key).join(best, F.col("__row") == F.col("__key"), "left_semi")
    return kept.dropDuplicates(["__row"]).drop("__row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of a document, in the order of the mix."""
    sized = docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))
    return mixing.in_mix_order(mixing.mix_sources(sized))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_templates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
]

#: The rules are learned, and templates and groups follow from hashes and iteration; tests hold a brute-force version against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.

    Null and empty texts are rejected by the first stage. A doc_id may be null or shared by several texts. No documents give no
    rows; without labels only the base rules hold, without benchmark items nothing is contaminated.
    """
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
