"""Every registered query against its SQL, and the feed they start from."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from checks import ORACLES, QUERIES, feed

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return connect(sf_dir)


def plain(value):
    if isinstance(value, float) and (math.isnan(value) or value == 0):
        return "nan" if math.isnan(value) else 0.0
    return value


def bag(rows):
    return sorted((tuple(map(plain, row)) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, oracle, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = oracle.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert bag(df.select(*names).collect()) == bag(cursor.fetchall())


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry_points.queries().keys()


def test_entry(spark):
    assert entry_points.entry(spark).count() == 6


def test_a_line_item_without_partners_is_no_campaign(spark, sf_dir, tmp_path):
    for name in ("lineitem", "supplier", "part", "orders", "customer", "nation"):
        feed.table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    dangling = feed.table(spark, sf_dir, "supplier").where("s_suppkey <> 3")
    dangling.write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
    rows = feed.campaigns(spark, str(tmp_path), "Campaign_ID")
    assert rows.where("l_suppkey = 3").isEmpty() and not rows.isEmpty()


def test_tie_break_is_a_total_order(spark, sf_dir):
    rows = feed.campaigns(spark, sf_dir, "Campaign_ID")
    counts = rows.groupBy("Campaign_ID", *feed.TIE_BREAK).count()
    keyed = counts.where("Campaign_ID IS NOT NULL AND count > 1")
    assert keyed.isEmpty()
