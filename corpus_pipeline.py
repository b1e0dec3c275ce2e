"""From raw documents to token ids: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import bpe, contamination, line_templates, near_copies, quality
from tabscope.llm.common import workroom
from tabscope.llm.queries import VOCABULARY, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL says what these stages do; they are tested against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance resampling; the others go."""
    return quality.resample(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; every document stays."""
    left = line_templates.drop_recurring_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each family of near copies (five-word Jaccard of 0.8 or more) stays: the one with the smallest id.

    op1's fingerprints and Golay keys propose pairs, MinHash bands those beyond their four bits; exact Jaccard decides."""
    return near_copies.keep_one(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return contamination.without_passages(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and the text they decode to."""
    coded = bpe.encode_documents(docs, VOCABULARY)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality), ("lines", line_dedup), ("near_duplicates", near_dedup),
    ("decontamination", decontaminate), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    room = workroom(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{room}/{name}")
        docs = spark.read.parquet(f"{room}/{name}")
    return docs
