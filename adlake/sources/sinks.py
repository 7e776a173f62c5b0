"""Plain Parquet sinks and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


#: Rows of a file at most. Rows of a few words pack so well that a scan task of a given size
#: in bytes would read millions of them, and hold them where it sorts; of files with so
#: few it reads some thirty, as each counts with the 4 MB that opening it is taken to cost.
ROWS_PER_FILE = 40_000


def overwrite(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "snappy"
) -> None:
    """Replace ``path``. Spark refuses a path that ``df`` itself reads; use
    :class:`adlake.sources.lake.Lake` for tables that are rebuilt from themselves."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path, compression=compression)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to ``path``; the first append creates it."""
    df.write.mode("append").parquet(path)


def typed_empty(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows, but all columns: what an empty input turns into."""
    return spark.createDataFrame([], schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors can reach.

    It lies below ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder serves a local session; on a cluster it is an error, as a folder of
    one machine would be of no use to the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="run-")
    return f"{base.rstrip('/')}/adlake/{name}-{uuid.uuid4().hex}"
