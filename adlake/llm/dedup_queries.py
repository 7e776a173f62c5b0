"""The queries of the SimHash operator and of the join by Jaccard similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.llm import jaccard, simhash
from adlake.llm.common import table
from adlake.llm.registry import registered


@registered()
def op2_simhash_vp_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.hex("print")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


@registered()
def op13_universe_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of shingles, and its component of similar ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
    )
