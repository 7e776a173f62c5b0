"""The query of language-model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.llm import pitman_yor
from adlake.llm.common import table
from adlake.llm.registry import registered


@registered()
def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document, and that of plain word counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.score_corpus(docs).select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        "train_tokens",
        F.col("base").alias("base_score"),
        "score",
        "perplexity",
    )
