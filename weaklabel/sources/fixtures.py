"""Inputs derived from the driver's tables (FIXTURES.md §1-2). Everything
here reads whole tables; nothing is sampled or capped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import hash_vector
from .corpus import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    # text tables are expensive per byte: give them every core
    return spread(df) if name in ("documents", "benchmark") else df


def corpus_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a corpus labelled by language (4 classes)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("sentence"), F.col("lang").alias("label"))


def corpus_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a corpus labelled by source (20 classes)."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("sentence"), F.col("source").alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with DOUBLE components."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


def binary_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")


def short_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")


def hash_word_vectors(vocab: DataFrame, dim: int = 16) -> DataFrame:
    """Word vectors SQL can repeat: one row per term of ``vocab(term, n_occ)``."""
    return vocab.select("term", hash_vector(F.col("term"), dim).alias("vector"),
                        F.col("n_occ").cast("bigint").alias("n_occ"))
