"""What the operators of this folder share."""

from __future__ import annotations

import io
import os
import zipfile
from contextlib import contextmanager

import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake.sources import shared_dir

#: Characters between words, wherever a contract says ``[^\x20\x09-\x0D]+``.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let executors import this library, whatever folder the driver runs in."""
    context = spark.sparkContext
    if any(path.endswith("adlake_code.zip") for path in context._python_includes):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = os.path.join(context._temp_dir, "adlake_code.zip")
    with open(path, "wb") as file:
        file.write(packed.getvalue())
    context.addPyFile(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within this, what a write has shuffled is removed from the executors' disks once it
    is done, instead of when the driver's memory is next tidied up. For writes whose results
    alone are read again. The session's setting is as before afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, no part
    is computed twice, and a lost executor takes nothing along."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The maximal runs outside ``[\\x20\\x09-\\x0D]``; of null text none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(batches, column: int, most: int = 8 << 20):
    """The rows of Arrow batches, in slices of about ``most`` bytes of one column."""
    for batch in batches:
        at, size = 0, 0
        for i, length in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            size += length
            if size >= most:
                yield batch.slice(at, i + 1 - at)
                at, size = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file in the shared store, for tasks."""
    return fs.FileSystem.from_uri(uri)
