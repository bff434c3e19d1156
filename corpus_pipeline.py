"""A training-data pipeline over documents: each stage takes the one before it, and the last packs what is left into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm import ngram_join, quality, secrets, suffix_dedup
from xylem.llm.common import read_table
from xylem.llm.packing import pack
from xylem.llm.queries import BYTE_BPE
from xylem.ship import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.classify(docs, read_table(ship(spark), sf_dir, "labels")).where("keep").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays.

    Rows with the same doc_id and text are one document: one of them stays,
    that with the least other columns. Rows with the same doc_id and different
    texts are documents by themselves, as are rows without a doc_id, which
    stand after all others; ties go by hash.
    """
    ship(spark)
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        docs = docs.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("o")).select("doc_id", "text", "o.*")
        keyed = docs.withColumn("key", F.xxhash64("doc_id", "text"))
        found = ngram_join.jaccard_components(keyed, id_col="key").select(F.col("doc_id").alias("key"), "component_id")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
        stay = keyed.select("doc_id", "key").join(found, "key").groupBy("component_id").agg(F.min(order)["key"].alias("key")).select("key")
        return keyed.join(stay, "key", "left_semi").select(*COLUMNS)
    gone = ngram_join.jaccard_components(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has go; documents stay."""
    ship(spark)
    found = suffix_dedup.deduplicate(docs, with_text=True, carry=("lang", "source", "n_chars"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast("long")
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; documents stay."""
    n_chars = F.when(F.size("secret_spans") > 0, F.length("redacted")).otherwise(F.col("n_chars")).cast("long")
    return secrets.scan(docs).select("doc_id", F.col("redacted").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    ship(spark)
    # workers outlive their stage: what they remember stands beside the other stages' memory
    return pack(docs, BYTE_BPE, remembered=300_000)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Learned decisions and the search for sequences have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
