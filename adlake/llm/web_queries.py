"""Queries of the operators on web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.llm import host_paths, warc
from adlake.llm.common import stored, table
from adlake.llm.registry import registered
from adlake.sources import shared_dir


@registered()
def op5_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back; a revisit's size is its response's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = warc.write_archives(pages, shared_dir(spark, "warc"))
    read = warc.read_archives(spark, archives).select(
        "page_id",
        "record_type",
        "refers_to",
        "payload_digest",
        F.octet_length("payload").cast("long").alias("own_bytes"),
    )
    records = stored(read, "records")
    named = records.select(F.col("refers_to").alias("named")).where("named IS NOT NULL").distinct()
    sizes = stored(
        records.where("record_type = 'response'")
        .join(named, F.col("page_id") == F.col("named"), "left_semi")
        .groupBy(F.col("page_id").alias("refers_to"))
        .agg(F.max("own_bytes").alias("full_bytes")),
        "sizes",
    )
    return records.join(sizes, "refers_to", "left").select(
        "page_id",
        F.coalesce("full_bytes", "own_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )


@registered()
def op6_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return host_paths.extract(pages).select(
        F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars")
    )
