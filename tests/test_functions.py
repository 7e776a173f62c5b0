"""Scalar expressions against hand-written rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from adlake import functions as X


def apply(spark, values, sql_type, function):
    rows = spark.createDataFrame(
        [(i, v) for i, v in enumerate(values)], f"i int, v {sql_type}"
    )
    found = rows.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [row.r for row in found]


def test_ansi_mode_is_on(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_parse_currency(spark):
    texts = ["$16,174.00", "7", "-5", "bad", "", None, "$1,234,567.89"]
    assert apply(spark, texts, "string", X.parse_currency) == [
        16174.0,
        7.0,
        -5.0,
        None,
        None,
        0.0,
        1234567.89,
    ]


def test_parse_date(spark):
    texts = [
        "2021-01-01",
        "13-02-2021",
        "02/13/2021",
        "01-02-2021",
        "31-02-2021",
        "junk",
        None,
    ]
    assert apply(spark, texts, "string", X.parse_date) == [
        dt.date(2021, 1, 1),
        dt.date(2021, 2, 13),
        dt.date(2021, 2, 13),
        dt.date(2021, 2, 1),
        None,
        None,
        None,
    ]


def test_conversion_category(spark):
    rates = [None, 0.049, 0.05, 0.10, 0.11, math.nan]
    assert apply(spark, rates, "double", X.conversion_category) == [
        "Low",
        "Low",
        "Medium",
        "Medium",
        "High",
        "High",
    ]


ROIS = [None, -2.0, -1.0, -0.5, 0.0, 1.0, 5.0, 6.0]


def test_adjusted_roi(spark):
    expected = [None, -1.0, -1.0, -0.5, 0.0, 1.0, 5.0, 5.0]
    assert apply(spark, ROIS, "double", X.adjusted_roi) == expected
    assert apply(spark, [math.nan], "double", X.adjusted_roi) == [5.0]


def test_roi_risk(spark):
    high, medium, low = "High Risk", "Medium Risk", "Low Risk"
    expected = [high, high, high, high, medium, low, low, low]
    assert apply(spark, ROIS, "double", X.roi_risk) == expected


@pytest.mark.parametrize(
    ("numerator", "denominator", "expected"),
    [(1, 2, 0.5), (1, 0, 0.0), (1, None, 0.0), (None, 2, None), (3, -2, -1.5)],
)
def test_safe_div(spark, numerator, denominator, expected):
    df = spark.createDataFrame([(numerator, denominator)], "n int, d int")
    result = df.select(X.safe_div(F.col("n"), F.col("d")).alias("r"))
    assert result.schema["r"].dataType.simpleString() == "double"
    assert result.first().r == expected


def test_the_two_click_rates_differ_for_negative_impressions_only(spark):
    pairs = [(5, 10), (5, 0), (5, None), (None, 10), (5, -10)]
    df = spark.createDataFrame(pairs, "c int, i int")
    found = df.select(
        X.ctr(F.col("c"), F.col("i")), X.ctr_when_served(F.col("c"), F.col("i"))
    ).collect()
    assert [tuple(row) for row in found] == [
        (0.5, 0.5),
        (0.0, 0.0),
        (0.0, 0.0),
        (None, None),
        (-0.5, 0.0),
    ]


def test_outside_unit_range(spark):
    values = [-0.1, 0.0, 0.5, 1.0, 1.1, None]
    expected = [True, False, False, False, True, None]
    assert apply(spark, values, "double", X.outside_unit_range) == expected


def test_any_negative_is_three_valued(spark):
    df = spark.createDataFrame(
        [(1, 1), (-1, None), (None, 1), (1, -1)], "a int, b int"
    )
    found = df.select(X.any_negative([F.col("a"), F.col("b")]).alias("r")).collect()
    assert [row.r for row in found] == [False, True, None, True]
