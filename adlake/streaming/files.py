"""File-source ingestion: the stream's checkpoint knows which files are new.

Only the step from raw files to bronze is a stream: it is stateless, and the
Parquet sink is exactly-once. Dedupe and anti joins against whole layers follow
as the batch steps of an increment.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from adlake import spec as S
from adlake.plans.increment import as_bronze, propagate, require_later
from adlake.sources import lake as L
from adlake.sources.lake import Lake
from adlake.sources.readers import (
    read_or_empty,
    sound_rows,
    to_micros,
    with_corrupt_record,
    with_lineage,
)
from adlake.sources.sinks import ROWS_PER_FILE
from adlake.spec import DEFAULT_SPEC, CampaignSpec

#: The run that brought a row, by its time in microseconds.
RUN = "run"


def stream_to_bronze(
    spark: SparkSession,
    raw_path: str,
    root: str,
    spec: CampaignSpec = DEFAULT_SPEC,
    run_ts: datetime | None = None,
) -> str:
    """Append all files not read before to the streamed bronze table, and stop.

    The table is partitioned by run, so that what a layer has not taken over yet is a
    filter on partitions, and by whether records could be read. Returns its path.
    """
    run_ts = run_ts or datetime.now(UTC)
    target = f"{root.rstrip('/')}/{L.STREAMED}"
    files = (
        spark.readStream.schema(with_corrupt_record(spec.raw_schema, S.CORRUPT_RECORD))
        .option("header", True)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", S.CORRUPT_RECORD)
        .csv(raw_path)
    )
    query = (
        as_bronze(with_lineage(files), run_ts)
        .withColumn(RUN, F.lit(to_micros(run_ts)))
        .writeStream.format("parquet")
        .partitionBy(RUN, S.QUARANTINED)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("checkpointLocation", f"{target}_checkpoint")
        .option("path", target)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return target


def run_stream(
    spark: SparkSession,
    raw_path: str,
    root: str,
    spec: CampaignSpec = DEFAULT_SPEC,
    run_ts: datetime | None = None,
    metrics_mode: str = "recompute",
) -> dict[str, int]:
    """Ingest what is new below ``raw_path`` and carry it through all layers.

    Run it on a schedule with rising ``run_ts``. A lake takes either streams or
    batches: marks of the one say nothing about the other. Rows added per layer are
    returned.
    """
    run_ts = run_ts or datetime.now(UTC)
    lake = Lake(spark, root)
    require_later(lake, run_ts)
    if lake.has(L.BRONZE):
        raise ValueError("this lake is fed by batches")
    table = stream_to_bronze(spark, raw_path, root, spec, run_ts)
    schema = StructType([*spec.stored_schema.fields, StructField(RUN, LongType())])
    bronze = sound_rows(read_or_empty(spark, table, schema))

    def bronze_since(time: int | None) -> DataFrame:
        rows = bronze if time is None else bronze.where(F.col(RUN) > time)
        return rows.drop(RUN)

    return propagate(lake, bronze_since, to_micros(run_ts), spec, run_ts, metrics_mode)
