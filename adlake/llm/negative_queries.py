"""The query of hard-negative mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.llm import hard_negatives
from adlake.llm.common import table
from adlake.llm.registry import registered


@registered()
def op12_segment_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; one label in seven is off by one."""
    off = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", off.alias("label"))
    return hard_negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"))
