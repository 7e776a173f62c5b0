"""Table readers and the small reports that describe what was read.

Paths go straight to Spark, so any file system Spark knows will do; nothing
here looks at a local disk.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from adlake import spec as S

NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def with_corrupt_record(schema: StructType, name: str) -> StructType:
    """``schema`` with a text column that takes up records which don't fit it."""
    if name in schema.names:
        return schema
    return StructType([*schema.fields, StructField(name, StringType())])


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | None = S.RAW_SCHEMA,
    header: bool = True,
    corrupt: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV files or directories.

    With a schema (the default) no inference pass is made, and a column keeps
    its type whatever files are present. A header that differs from the schema
    raises an error, it is not mapped by position. ``schema=None`` infers.

    ``corrupt`` names a further column: of a record with too few or too many cells, or
    with a cell that is no value of its type, it holds the text as it is in the file; of
    others it is null. Records end with their line, so that files can be split. With
    ``multi_line`` quoted cells may hold line breaks, and a file is read by one task;
    without, such a record comes out as broken ones.
    """
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    reader = reader.option("multiLine", multi_line)
    if schema is None:
        inferred = reader.option("inferSchema", True).csv(path)
        if corrupt is None:
            return inferred
        schema = inferred.schema
    if corrupt is not None:
        schema = with_corrupt_record(schema, corrupt)
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).option("enforceSchema", not header).csv(path)


def unreadable_cells(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType = S.RAW_SCHEMA,
    header: bool = True,
) -> DataFrame:
    """CSV cells that hold text but not a value of their column's type, which a read
    with the schema makes null: ``source_file``, ``column`` and ``unreadable``, their
    number, for every file and column that has some. One scan, one row per file."""
    texts = StructType([StructField(field.name, StringType()) for field in schema])
    typed = [field for field in schema if not isinstance(field.dataType, StringType)]
    lost = []
    for field in typed:
        text = F.col(f"`{field.name}`")
        reads = text.try_cast(field.dataType).isNotNull()
        if isinstance(field.dataType, IntegralType):
            reads = reads & text.rlike(r"^[+-]?[0-9]+$")
        lost.append(F.count_if(text.isNotNull() & ~reads).alias(field.name))
    per_file = with_lineage(read_csv(spark, path, texts, header)).groupBy(S.SOURCE_FILE).agg(*lost)
    named = F.explode(
        F.array(
            *(
                F.struct(F.lit(field.name).alias("column"), F.col(f"`{field.name}`").alias("unreadable"))
                for field in typed
            )
        )
    )
    return per_file.select(S.SOURCE_FILE, named.alias("cell")).select(
        S.SOURCE_FILE, "cell.column", "cell.unreadable"
    ).where("unreadable > 0")


def read_parquet(
    spark: SparkSession, path: str | list[str], schema: StructType | None = None
) -> DataFrame:
    """Parquet snapshot; with a schema no footer is read to find it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([path] if isinstance(path, str) else path))


def read_json(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | None = None,
    corrupt: str | None = None,
) -> DataFrame:
    """JSON lines; with a schema there is no inference pass.

    ``corrupt`` names a further column with the text of lines that are no JSON object or
    hold a value of another type; of others it is null.
    """
    reader = spark.read
    if corrupt is not None:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
        schema = with_corrupt_record(reader.json(path).schema if schema is None else schema, corrupt)
    return (reader if schema is None else reader.schema(schema)).json(path)


def set_apart(df: DataFrame, corrupt: str = S.CORRUPT_RECORD) -> DataFrame:
    """Add :data:`~adlake.spec.QUARANTINED`, whether a record could not be read. A table
    without the column of corrupt records has none.

    Store the result before asking for some of its columns: Spark parses no cells that a
    query does not need, so a query over the files may not see what is wrong with others.
    """
    if corrupt not in df.columns:
        df = df.withColumn(corrupt, F.lit(None).cast("string"))
    return df.withColumn(S.QUARANTINED, F.col(corrupt).isNotNull())


def sound_rows(df: DataFrame, corrupt: str = S.CORRUPT_RECORD) -> DataFrame:
    """The rows that were read as they are in the file, without the columns that tell.
    Where a table is partitioned by the mark, the others aren't opened."""
    mark = ~F.col(S.QUARANTINED) if S.QUARANTINED in df.columns else F.col(corrupt).isNull()
    return df.where(mark).drop(corrupt, S.QUARANTINED)


def quarantined_rows(df: DataFrame, corrupt: str = S.CORRUPT_RECORD) -> DataFrame:
    """File, ingestion time and text of the records that could not be read."""
    kept = [name for name in (S.SOURCE_FILE, S.INGESTED_AT) if name in df.columns]
    mark = F.col(S.QUARANTINED) if S.QUARANTINED in df.columns else F.col(corrupt).isNotNull()
    return df.where(mark).select(*kept, corrupt)


def quarantine_counts(df: DataFrame, corrupt: str = S.CORRUPT_RECORD) -> DataFrame:
    """``source_file`` and ``quarantined``, the number of its records that could not be
    read, for every file that has some."""
    found = quarantined_rows(df, corrupt).groupBy(S.SOURCE_FILE)
    return found.agg(F.count(F.lit(1)).alias("quarantined"))


def read_any(
    spark: SparkSession,
    path: str | list[str],
    file_format: str = "parquet",
    header: bool = True,
    infer_schema: bool = True,
    schema: StructType | None = None,
) -> DataFrame:
    """Read by format name, upper or lower case.

    Unknown formats raise ``ValueError``, missing paths ``AnalysisException``.
    """
    fmt = file_format.lower()
    if fmt == "parquet":
        return read_parquet(spark, path, schema)
    if fmt == "json":
        return read_json(spark, path, schema)
    if fmt == "csv":
        if schema is not None or infer_schema:
            return read_csv(spark, path, schema, header)
        return spark.read.option("header", header).csv(path)
    raise ValueError(f"unsupported file format: {file_format!r}")


def read_or_empty(
    spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet"
) -> DataFrame:
    """The table at ``path``, or an empty one of ``schema`` if there is none."""
    try:
        return read_any(spark, path, file_format, schema=schema)
    except AnalysisException as error:
        if error.getCondition() in NOTHING_THERE:
            return spark.createDataFrame([], schema)
        raise


def has_rows(df: DataFrame) -> bool:
    """Probe for one row; never counts."""
    return not df.isEmpty()


def with_lineage(df: DataFrame, name: str = S.SOURCE_FILE) -> DataFrame:
    """Add the file each row was read from. ``df`` must be a file scan."""
    return df.withColumn(name, F.col("_metadata.file_path"))


def to_micros(run_ts: datetime) -> int:
    """Microseconds since the epoch; a time without zone is taken as UTC."""
    if run_ts.tzinfo is None:
        run_ts = run_ts.replace(tzinfo=UTC)
    return (run_ts - datetime.fromtimestamp(0, UTC)) // timedelta(microseconds=1)


def time_literal(micros: int) -> Column:
    """A timestamp constant that no session or driver time zone can shift."""
    return F.timestamp_micros(F.lit(micros))


def stamp(df: DataFrame, name: str, run_ts: datetime) -> DataFrame:
    """Add an audit time: one literal for the whole run.

    ``current_timestamp()`` would be evaluated anew in every derived query.
    """
    return df.withColumn(name, time_literal(to_micros(run_ts)))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def schema_listing(df: DataFrame) -> DataFrame:
    """One row per column, with the table's row and column counts."""
    fields = F.array(
        *(
            F.struct(
                F.lit(position).alias("ordinal"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.lit(field.nullable).alias("nullable"),
            )
            for position, field in enumerate(df.schema.fields, start=1)
        )
    )
    return row_count(df).select(
        F.inline(fields), "row_count", F.lit(len(df.columns)).alias("column_count")
    )


def sample_rows(df: DataFrame, n: int, order_by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows as JSON text (nulls left out): the first in ``order_by``, or
    without one any, for which Spark reads no more than it needs."""
    first = (df.orderBy(*order_by) if order_by else df).limit(n)
    return first.select(F.to_json(F.struct("*")).alias("row_json"))


def read_report(df: DataFrame, show_rows: int = 10) -> dict[str, DataFrame]:
    """What a reader wants to know about a table: schema with counts, sample."""
    return {"schema": schema_listing(df), "sample": sample_rows(df, show_rows)}


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` available to SQL under ``name``."""
    df.createOrReplaceTempView(name)
    return df
