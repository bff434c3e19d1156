"""One query for each operator: (spark, sf_dir) -> its whole result over its whole table, with production parameters."""

from __future__ import annotations


import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xylem.llm import embed_dedup, langid, ngram_join, quality, secrets, sp_sampling, suffix_dedup, topk
from xylem.llm.common import read_table
from xylem.llm.packing import pack
from xylem.llm.sql import ORACLES
from xylem.llm.token_files import read_token_files, write_token_files

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(read_table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(read_table(spark, sf_dir, "documents"), BYTE_BPE))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_sampling.sample_segmentations(read_table(spark, sf_dir, "documents"), PIECES)


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_components(read_table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "text_score", "metadata_score", "quality_score", "keep")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
