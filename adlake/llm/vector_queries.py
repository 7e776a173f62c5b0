"""The query of the nearest-neighbour operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlake.llm import multi_index
from adlake.llm.common import table
from adlake.llm.registry import registered


@registered()
def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multi_index.nearest(rows, rows.where("vec_id % 50 = 0"))
