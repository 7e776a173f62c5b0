"""Queries of the operators on token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlake.llm import bitplanes, chunks, packing
from adlake.llm.common import table
from adlake.llm.registry import registered
from adlake.sources import shared_dir


@registered()
def op4_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunks.digests(chunks.encode(docs))


@registered()
def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files of bit planes and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = bitplanes.write_ids(docs, shared_dir(spark, "planes"))
    return bitplanes.read_ids(spark, manifest)


@registered()
def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 1024 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs)
