"""Sources, sinks and the reports about them."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake import sources as io
from adlake.plans.increment import extend_bronze
from adlake.sources import Lake
from adlake.sources.sinks import ROWS_PER_FILE
from adlake.spec import CORRUPT_RECORD, DEFAULT_SPEC
from checks import feed
from checks.feed import BUSINESS, SPEC, SPLIT_DAY, sql
from checks.registry import checked

FIRST_RUN = datetime(2026, 2, 2, tzinfo=UTC)
BUSINESS_LIST = ", ".join(f'"{name}"' for name in BUSINESS)


def write_csv(df: DataFrame, path: str) -> None:
    """Raw files as they are often delivered: packed, and none too large for a task."""
    df.write.option("header", True).option("maxRecordsPerFile", ROWS_PER_FILE).csv(path, compression="gzip")


@checked(sql(f"SELECT {BUSINESS_LIST} FROM campaigns"))
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.shared_dir(spark, "scan_csv")
    write_csv(feed.campaigns(spark, sf_dir).select(*BUSINESS), path)
    return io.read_csv(spark, path)


@checked(
    sql(
        """SELECT CAST(count(*) FILTER (l_linenumber = 1) AS BIGINT) AS keys,
                  CAST(count(*) FILTER (l_linenumber = 2 AND Impressions IS NOT NULL) AS BIGINT)
                    AS impressions,
                  CAST(count(*) FILTER (l_linenumber = 3 AND Clicks IS NOT NULL) AS BIGINT)
                    AS clicks
           FROM campaigns"""
    )
)
def scan_csv_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters in keys, thousands commas and decimals in whole numbers, counted."""
    rows = feed.campaigns(spark, sf_dir)
    line = F.col("l_linenumber")
    dirty = {
        "Campaign_ID": F.when(line == 1, F.lit("x1")),
        "Impressions": F.when(
            (line == 2) & F.col("Impressions").isNotNull(), F.lit("1,000")
        ),
        "Clicks": F.when(
            (line == 3) & F.col("Clicks").isNotNull(), F.concat(F.col("Clicks"), F.lit(".0"))
        ),
    }
    mixed = rows.withColumns(
        {name: F.coalesce(value, F.col(name).cast("string")) for name, value in dirty.items()}
    )
    path = io.shared_dir(spark, "scan_csv_dirty")
    write_csv(mixed.select(*BUSINESS), path)
    found = io.unreadable_cells(spark, path)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("column") == name, F.col("unreadable"))), F.lit(0))

    return found.agg(
        total("Campaign_ID").alias("keys"),
        total("Impressions").alias("impressions"),
        total("Clicks").alias("clicks"),
    )


KIND = """CASE l_orderkey % 7 WHEN 0 THEN 'short' WHEN 1 THEN 'long' WHEN 2 THEN 'broken'
          ELSE 'sound' END"""


def ragged_csv(spark: SparkSession, sf_dir: str, path: str) -> None:
    """CSV text in three folders, without headers: of every seven orders the records of one
    lack their last cell, those of another have one too many, and those of a third have a
    line break within quotes."""
    rows = feed.campaigns(spark, sf_dir, *BUSINESS, keep=("l_orderkey",)).withColumn("kind", F.col("l_orderkey") % 7)
    first = BUSINESS[0]
    inner = F.struct(*BUSINESS[2:])
    line = (
        F.when(F.col("kind") == 0, F.to_csv(F.struct(*BUSINESS[:-1])))
        .when(F.col("kind") == 1, F.concat(F.to_csv(F.struct(*BUSINESS)), F.lit(",more")))
        .when(
            F.col("kind") == 2,
            F.concat(F.coalesce(F.col(first).cast("string"), F.lit("")), F.lit(',"one\ntwo",'), F.to_csv(inner)),
        )
        .otherwise(F.to_csv(F.struct(*BUSINESS)))
    )
    files = rows.select(line.alias("value"), (F.col("l_linenumber") % 3).alias("file"))
    writer = files.write.partitionBy("file").option("maxRecordsPerFile", ROWS_PER_FILE)
    writer.text(path, compression="gzip")


def per_file(df: DataFrame, *more: Column) -> DataFrame:
    """Records that could be read and others, for each folder of files."""
    folder = F.regexp_extract("source_file", "file=([0-9])", 1).cast("int").alias("file")
    return df.groupBy(folder).agg(
        F.count_if(~F.col("quarantined")).alias("sound"), F.count_if("quarantined").alias("broken"), *more
    )


@checked(
    sql(
        f"""SELECT l_linenumber % 3 AS file,
                   count(*) FILTER ({KIND} = 'sound') AS sound,
                   CAST(count(*) FILTER ({KIND} IN ('short', 'long'))
                        + 2 * count(*) FILTER ({KIND} = 'broken') AS BIGINT) AS broken,
                   CAST(sum(CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_quantity > 48 THEN 0
                                 ELSE CAST(l_quantity AS INTEGER) END)
                        FILTER ({KIND} = 'sound') AS BIGINT) AS clicks
            FROM lineitem GROUP BY 1"""
    )
)
def scan_csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded twice, line by line: short and long records and both halves of a broken one
    lie in quarantine once."""
    root = io.shared_dir(spark, "scan_csv_ragged")
    ragged_csv(spark, sf_dir, f"{root}/raw")
    lake = Lake(spark, f"{root}/lake")
    for hours in range(2):
        raw = io.read_csv(spark, f"{root}/raw", header=False, corrupt=CORRUPT_RECORD)
        extend_bronze(lake, io.with_lineage(raw).drop("file"), DEFAULT_SPEC, FIRST_RUN + timedelta(hours=hours))
    clicks = F.sum(F.when(~F.col("quarantined"), F.col("Clicks"))).alias("clicks")
    return per_file(lake.read("bronze"), clicks)


@checked(
    sql(
        f"""SELECT l_linenumber % 3 AS file,
                   count(*) FILTER ({KIND} NOT IN ('short', 'long')) AS sound,
                   count(*) FILTER ({KIND} IN ('short', 'long')) AS broken,
                   count(*) FILTER ({KIND} = 'broken') AS of_two_lines
            FROM lineitem GROUP BY 1"""
    )
)
def scan_csv_multi_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files with line breaks in quotes read as part of their cell."""
    path = io.shared_dir(spark, "scan_csv_multi_line")
    ragged_csv(spark, sf_dir, path)
    raw = io.read_csv(spark, path, header=False, corrupt=CORRUPT_RECORD, multi_line=True)
    of_two = F.count_if((F.col("Company") == "one\ntwo") & ~F.col("quarantined"))
    return per_file(io.set_apart(io.with_lineage(raw)), of_two.alias("of_two_lines"))


@checked(
    """SELECT CAST(event_id % 3 AS INTEGER) AS file,
              count(*) FILTER (event_id % 5 > 1) AS sound,
              count(*) FILTER (event_id % 5 <= 1) AS broken,
              round(coalesce(sum(value) FILTER (event_id % 5 > 1), 0), 4) AS value_total
       FROM events GROUP BY 1"""
)
def scan_json_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every five lines one is cut off and another holds text for a number."""
    path = io.shared_dir(spark, "scan_json_corrupt")
    events = feed.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    odd = F.to_json(F.struct(F.lit("many").alias("event_id"), "event_type"))
    kind = F.col("event_id") % 5
    text = F.when(kind == 0, F.substring(line, F.lit(1), F.length(line) - 1)).when(kind == 1, odd).otherwise(line)
    files = events.select(text.alias("value"), (F.col("event_id") % 3).alias("file"))
    files.write.partitionBy("file").text(path)
    lines = io.set_apart(io.with_lineage(io.read_json(spark, path, events.schema, corrupt=CORRUPT_RECORD)))
    found = feed.stored(lines, "scan_json_corrupt")
    total = F.coalesce(F.sum(F.when(~F.col("quarantined"), F.col("value"))), F.lit(0.0))
    return per_file(found, F.round(total, 4).alias("value_total"))


@checked(
    """SELECT n_nationkey::VARCHAR AS key, n_name AS name, 'no types' AS read FROM nation
       UNION ALL SELECT n_nationkey::VARCHAR, n_name, 'no header' FROM nation"""
)
def read_any_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV without inference, and without a header line."""
    nations = feed.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = io.shared_dir(spark, "read_any_flags")
    write_csv(nations, f"{path}/with")
    nations.write.csv(f"{path}/without")
    plain = io.read_any(spark, f"{path}/with", "csv", infer_schema=False)
    bare = io.read_any(spark, f"{path}/without", "CSV", header=False)
    parts = [
        df.select(F.col(df.columns[0]).cast("string").alias("key"), F.col(df.columns[1]).alias("name"), F.lit(kind).alias("read"))
        for df, kind in ((plain, "no types"), (bare, "no header"))
    ]
    return parts[0].unionByName(parts[1])


@checked(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
              l_extendedprice, l_returnflag FROM lineitem"""
)
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_parquet(spark, f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
    )


@checked("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = io.shared_dir(spark, "scan_json")
    events = feed.table(spark, sf_dir, "events")
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    events.write.option("timestampNTZFormat", micros).json(path)
    return io.read_json(spark, path, events.schema)


@checked(
    """SELECT fmt AS file_format, count(*) AS row_count,
              CAST(sum(c_custkey) AS BIGINT) AS key_total,
              round(sum(c_acctbal), 2) AS balance_total,
              5 AS column_count
       FROM customer, (VALUES ('parquet'), ('CSV'), ('Json')) f(fmt) GROUP BY fmt"""
)
def read_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = feed.table(spark, sf_dir, "customer")
    path = io.shared_dir(spark, "read_any")
    write_csv(customer, f"{path}/csv")
    customer.write.json(f"{path}/json")
    result = None
    for fmt, where in (
        ("parquet", f"{sf_dir}/customer.parquet"),
        ("CSV", f"{path}/csv"),
        ("Json", f"{path}/json"),
    ):
        df = io.read_any(spark, where, fmt)
        part = df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.sum("c_custkey").alias("key_total"),
            F.round(F.sum("c_acctbal"), 2).alias("balance_total"),
        ).select(F.lit(fmt).alias("file_format"), "*", F.lit(len(df.columns)).alias("column_count"))
        result = part if result is None else result.unionByName(part)
    return result


@checked(
    """SELECT 'present' AS input, count(*) AS row_count FROM orders
       UNION ALL SELECT 'missing', 0"""
)
def read_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = f"{sf_dir}/orders.parquet"
    schema = io.read_parquet(spark, present).schema
    missing = io.shared_dir(spark, "nothing_here")
    counts = [
        io.row_count(io.read_or_empty(spark, path, schema)).select(
            F.lit(name).alias("input"), "row_count"
        )
        for name, path in (("present", present), ("missing", missing))
    ]
    return counts[0].unionByName(counts[1])


CAMPAIGN_TYPES = ", ".join(
    f"({position}, '{field.name}', '{field.dataType.simpleString()}')"
    for position, field in enumerate(SPEC.raw_schema.fields[:16], start=1)
)


@checked(
    sql(
        f"""SELECT v.ordinal, v."column", v."type", 0::BIGINT AS empty_rows,
                   (SELECT count(*) FROM campaigns) AS source_rows
            FROM (VALUES {CAMPAIGN_TYPES}) v(ordinal, "column", "type")"""
    )
)
def typed_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty bronze table keeps the columns and types of a full one."""
    full = feed.campaigns(spark, sf_dir).select(*BUSINESS)
    path = io.shared_dir(spark, "typed_empty")
    io.overwrite(io.typed_empty(spark, full.schema), path)
    stored = io.schema_listing(io.read_parquet(spark, path))
    source = io.schema_listing(full)
    return stored.select(
        "ordinal", "column", "type", F.col("row_count").alias("empty_rows")
    ).join(source.select("column", F.col("row_count").alias("source_rows")), "column")


@checked(
    sql(
        f"""SELECT CASE WHEN l_shipdate < TIMESTAMP '{SPLIT_DAY}' THEN 'drop_first'
                        ELSE 'drop_second' END AS source_folder,
                   count(*) AS row_count, count(Campaign_ID) AS keyed_rows
            FROM campaigns GROUP BY 1"""
    )
)
def bronze_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV files in two drops; each row tells where it came from."""
    path = io.shared_dir(spark, "bronze_lineage")
    rows = feed.campaigns(spark, sf_dir)
    write_csv(feed.earlier(rows).select(*BUSINESS), f"{path}/drop_first")
    write_csv(feed.later(rows).select(*BUSINESS), f"{path}/drop_second")
    bronze = io.with_lineage(io.read_csv(spark, f"{path}/drop_*"))
    folder = F.regexp_extract("source_file", "/(drop_[a-z]+)/", 1)
    return bronze.groupBy(folder.alias("source_folder")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("Campaign_ID").alias("keyed_rows"),
    )


def _json_field(name: str) -> str:
    number = name in {
        "Campaign_ID",
        "Conversion_Rate",
        "ROI",
        "Clicks",
        "Impressions",
        "Engagement_Score",
    }
    value = f'"{name}"' if number else f"'\"' || \"{name}\" || '\"'"
    return f"CASE WHEN \"{name}\" IS NOT NULL THEN '\"{name}\":' || {value} END"


SAMPLE_ORDER = ", ".join(["Campaign_ID NULLS FIRST", *feed.TIE_BREAK])


@checked(
    sql(
        f"""SELECT '{{' || concat_ws(',', {", ".join(_json_field(n) for n in BUSINESS)})
                   || '}}' AS row_json
            FROM (SELECT * FROM campaigns ORDER BY {SAMPLE_ORDER} LIMIT 10)"""
    )
)
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.campaigns(spark, sf_dir).drop("l_shipdate")
    first = io.sample_rows(rows, 10, ["Campaign_ID", *feed.TIE_BREAK])
    business = F.from_json("row_json", SPEC.raw_schema)
    fields = (business[name].alias(name) for name in BUSINESS)
    return first.select(F.to_json(F.struct(*fields)).alias("row_json"))


@checked(
    """SELECT v.*, (SELECT count(*) FROM lineitem) AS row_count, 11 AS column_count
       FROM (VALUES (1, 'l_orderkey', 'bigint', true), (2, 'l_partkey', 'bigint', true),
                    (3, 'l_suppkey', 'bigint', true), (4, 'l_linenumber', 'int', true),
                    (5, 'l_quantity', 'double', true),
                    (6, 'l_extendedprice', 'double', true),
                    (7, 'l_discount', 'double', true), (8, 'l_tax', 'double', true),
                    (9, 'l_returnflag', 'string', true),
                    (10, 'l_linestatus', 'string', true),
                    (11, 'l_shipdate', 'timestamp_ntz', true))
            v(ordinal, "column", "type", nullable)"""
)
def schema_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.schema_listing(feed.table(spark, sf_dir, "lineitem"))


@checked(
    """SELECT 'lineitem' AS input, EXISTS (SELECT 1 FROM lineitem) AS non_empty
       UNION ALL SELECT 'events', EXISTS (SELECT 1 FROM events)
       UNION ALL SELECT 'negative_quantity',
                        EXISTS (SELECT 1 FROM lineitem WHERE l_quantity < 0)"""
)
def is_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = feed.table(spark, sf_dir, "lineitem")
    probes = {
        "lineitem": lineitem,
        "events": feed.table(spark, sf_dir, "events"),
        "negative_quantity": lineitem.where(F.col("l_quantity") < 0),
    }
    found = [(name, io.has_rows(df)) for name, df in probes.items()]
    return spark.createDataFrame(found, "input string, non_empty boolean")
