"""Operators on small tables: nulls, boundaries, duplicates, skew."""

import datetime as dt
import math

import pytest
from conftest import rows_of
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from samples import campaign, raw_table

from adlake.operators import clean as C
from adlake.operators import gold as G
from adlake.operators import incremental as I
from adlake.operators import metrics as M
from adlake.operators import quality as Q
from adlake.operators import rollup as R
from adlake.spec import DEFAULT_SPEC as SPEC
from adlake.spec import CampaignSpec


def silver_table(spark, rows):
    return C.clean(raw_table(spark, rows), SPEC)


def test_clean_types_fills_and_keeps_one_row_per_key(spark):
    rows = [
        campaign(Campaign_ID=None),
        campaign(Campaign_ID=1, Date="13-02-2021", Clicks=None, ROI=None),
        campaign(Campaign_ID=2, Acquisition_Cost=None, Date="02/13/2021"),
        campaign(Campaign_ID=2, Acquisition_Cost=None, Date="02/13/2021"),
        campaign(Campaign_ID=3, Acquisition_Cost="oops", Date="n/a"),
    ]
    silver = silver_table(spark, rows)
    assert dict(silver.dtypes)["Acquisition_Cost"] == "double"
    assert dict(silver.dtypes)["Date"] == "date"
    found = rows_of(
        silver.select("Campaign_ID", "Acquisition_Cost", "Date", "Clicks", "ROI")
    )
    assert found == [
        (1, 16174.0, dt.date(2021, 2, 13), 0, 0.0),
        (2, 0.0, dt.date(2021, 2, 13), 506, 6.29),
        (3, None, None, 506, 6.29),
    ]


def test_non_iso_dates_survive_cleaning(spark):
    """Dates must be read from the raw text, not by a plain ISO cast."""
    days = ["2021-01-01", "02-01-2021", "01/03/2021"]
    rows = [campaign(Campaign_ID=i, Date=day) for i, day in enumerate(days)]
    assert silver_table(spark, rows).where(F.col("Date").isNull()).count() == 0


def test_dedupe_of_keys_alone(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "Campaign_ID long")
    kept = C.first_per_key(df, ["Campaign_ID"], C.dedupe_order(df, SPEC))
    assert rows_of(kept) == [(1,), (2,)]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_dedupe_does_not_depend_on_partitioning(spark, parts):
    rows = [campaign(Campaign_ID=i % 5, Clicks=i) for i in range(60)]
    df = raw_table(spark, rows).repartition(parts)
    kept = C.first_per_key(df, ["Campaign_ID"], C.dedupe_order(df, SPEC))
    assert rows_of(kept.select("Campaign_ID", "Clicks")) == [(i, i) for i in range(5)]


def test_dedupe_prefers_the_earliest_ingested(spark):
    df = spark.createDataFrame(
        [(1, "b", dt.datetime(2026, 1, 2)), (1, "c", dt.datetime(2026, 1, 1))],
        "Campaign_ID long, Company string, ingestion_timestamp timestamp",
    )
    kept = C.first_per_key(df, ["Campaign_ID"], C.dedupe_order(df, SPEC))
    assert kept.first().Company == "c"


def test_require_non_null_keeps_nan(spark):
    df = spark.createDataFrame([(1, math.nan), (2, None), (None, 1.0)], "a int, b double")
    assert [row.a for row in C.require_non_null(df, ["a", "b"]).collect()] == [1]


def test_business_filter(spark):
    cases = {
        1: {},
        2: {"Clicks": None, "Conversion_Rate": 0.1},
        3: {"Clicks": 0, "Conversion_Rate": 0.0},
        4: {"Channel_Used": None},
        5: {"Channel_Used": "Radio"},
        6: {"Acquisition_Cost": "bad"},
        7: {"Acquisition_Cost": "-5"},
        8: {"Acquisition_Cost": None},
        9: {"Impressions": 0},
        10: {"Impressions": None},
        11: {"Clicks": 0, "Conversion_Rate": 0.1},
    }
    rows = [campaign(Campaign_ID=key, **change) for key, change in cases.items()]
    kept = C.business_filter(silver_table(spark, rows), SPEC)
    assert [row.Campaign_ID for row in kept.orderBy("Campaign_ID").collect()] == [
        1,
        2,
        8,
        11,
    ]


def test_business_filter_before_filling_is_three_valued(spark):
    df = spark.createDataFrame(
        [(1, None, 0.1), (2, None, 0.0), (3, 0, None), (4, 1, None)],
        "Campaign_ID long, Clicks int, Conversion_Rate double",
    ).withColumns(
        {
            "Impressions": F.lit(10),
            "Acquisition_Cost": F.lit(1.0),
            "Channel_Used": F.lit("Email"),
        }
    )
    assert [r[0] for r in rows_of(C.business_filter(df, SPEC))] == [1, 4]


def test_unseen_rows_drops_null_keys_and_known_keys(spark):
    new = spark.createDataFrame([(1,), (2,), (None,)], "k long")
    existing = spark.createDataFrame([(1,), (None,)], "k long")
    assert rows_of(I.unseen_rows(new, existing, ["k"])) == [(2,)]


def brute_unseen(new, existing):
    known = {row[0] for row in existing}
    return sorted((r for r in new if r[0] is not None and r[0] not in known), key=repr)


@pytest.mark.parametrize("salts", [1, 4])
@pytest.mark.parametrize("measured", [True, False])
def test_unseen_rows_with_a_hot_key_on_both_sides(spark, salts, measured):
    """A third of the rows share one key; result as by brute force."""
    new = [(7 if i % 3 == 0 else i, i) for i in range(900)] + [(None, 1)]
    existing = [(11 if i % 3 == 0 else 2 * i, i) for i in range(600)]
    left = spark.createDataFrame(new, "k long, v long")
    right = spark.createDataFrame(existing, "k long, v long")
    batch = I.measure_keys(left, ["k"]) if measured else None
    found = I.unseen_rows(left, right, ["k"], batch, salts)
    assert found.columns == ["k", "v"]
    assert rows_of(found) == brute_unseen(new, existing)


def test_keys_are_measured_in_bytes(spark):
    df = spark.createDataFrame([("x" * 100,)] * 9 + [(None,)], "k string")
    batch = I.measure_keys(df, ["k"])
    assert batch.rows == 10
    assert batch.size == 9 * 100 + 10 * I.BYTES_PER_KEY
    assert batch.lowest == batch.highest == ("x" * 100,)
    assert batch.few is not None
    assert I.measure_keys(df, ["k"], batch.size - 1).few is None
    empty = I.measure_keys(df.limit(0), ["k"])
    assert (empty.rows, empty.size, empty.lowest) == (0, 0, (None,))


def test_filter_lets_all_own_keys_through_and_few_others(spark):
    df = spark.range(4000).select(F.concat(F.lit("key "), F.col("id")).alias("k"), "id")
    own = I.key_filter(df.where("id < 1000").unionByName(df.limit(0)), ["k", "id"], 1000)
    assert own.size == 256 and own.words.count() <= 256
    passed = I.may_be_in(df, ["k", "id"], own)
    assert passed.columns == df.columns
    found = {row.id for row in passed.collect()}
    assert set(range(1000)) <= found and len(found) < 1000 + 3000 * 0.03
    full = I.key_filter(df, ["k"], 4000, most=256)
    assert full.size == 256 and I.key_filter(df, ["k"], 4097, most=256) is None
    more = df.select(F.concat(F.lit("other "), F.col("id")).alias("k"))
    assert I.may_be_in(more, ["k"], full).count() < 4000 * 0.3


def test_filter_takes_whole_numbers_of_any_width_as_equal(spark):
    narrow = spark.createDataFrame([(1,), (-5,), (None,)], "k int")
    wide = spark.createDataFrame([(1,), (-5,), (1 << 40,), (None,)], "k long")
    for own, other in ((narrow, wide), (wide, narrow)):
        found = {row.k for row in I.may_be_in(other, ["k"], I.key_filter(own, ["k"], 4, most=1 << 16)).collect()}
        assert {1, -5} <= found and None not in found
    words = spark.createDataFrame([("1",)], "k string")
    assert I.may_be_in(words, ["k"], I.key_filter(wide, ["k"], 4)).count() == 1
    assert I.may_be_in(wide, ["k"], I.key_filter(wide.limit(0), ["k"], 0)).count() == 0


@pytest.mark.parametrize("words", [0, 1, 8, 1 << 20])
@pytest.mark.parametrize("salts", [1, 4])
def test_unseen_rows_of_a_batch_too_large_to_broadcast(spark, words, salts):
    """Whatever the filter lets through, the rows are those of brute force."""
    new = [(7 if i % 3 == 0 else i, i) for i in range(900)] + [(None, 1)]
    existing = [(11 if i % 3 == 0 else 2 * i, i) for i in range(600)] + [(None, 2)]
    left = spark.createDataFrame(new, "k long, v long")
    right = spark.createDataFrame(existing, "k int, v long")
    batch = I.measure_keys(left, ["k"], broadcast_bytes=0, filter_words=words)
    assert batch.few is None and (batch.filter is None) == (words < 900 / I.MOST_PER_WORD)
    assert rows_of(I.unseen_rows(left, right, ["k"], batch, salts)) == brute_unseen(new, existing)


@pytest.mark.parametrize(
    ("kind", "known", "new"),
    [
        ("a long, b string", [(1, "p"), (5, "q")], [(1, "p"), (5, "r"), (9, "q")]),
        ("a double, b date", [(1.0, None)], [(float("nan"), dt.date(2021, 1, 1))]),
        (
            "a double, b date",
            [(float("nan"), dt.date(2021, 1, 1)), (2.0, dt.date(2021, 1, 1))],
            [(float("nan"), dt.date(2021, 1, 1)), (2.0, dt.date(2021, 1, 2))],
        ),
    ],
)
def test_unseen_rows_by_compound_keys_of_any_type(spark, kind, known, new):
    left, right = spark.createDataFrame(new, kind), spark.createDataFrame(known, kind)
    keys = ["a", "b"]
    found = I.unseen_rows(left, right, keys, I.measure_keys(left, keys))
    expected = [row for row in new if repr(row) not in {repr(k) for k in known}]
    assert list(map(repr, rows_of(found))) == sorted(map(repr, expected))


def test_rollups_add_up(spark):
    """Two parts merged give the tables of the whole, gaps included."""
    schema = (
        "Campaign_ID long, Campaign_Type string, Channel_Used string, Date date,"
        "Conversion_Rate double, Acquisition_Cost double, ROI double, Clicks int,"
        "Impressions int, Engagement_Score int"
    )
    day = dt.date(2021, 1, 1)
    first = [
        (1, "Email", "Email", day, 0.2, 10.0, 6.0, 5, 10, 1),
        (2, None, None, None, None, None, None, None, None, None),
        (3, "Search", "Email", day, 0.05, 1.5, -2.0, 0, 10, 2),
    ]
    second = [
        (4, "Email", None, day, None, 2.0, None, None, 20, 3),
        (5, "Email", "YouTube", None, 0.1, 4.0, 0.5, 7, 0, None),
    ]
    a, b = (spark.createDataFrame(rows, schema) for rows in (first, second))
    rolled = R.merge_rollups(R.rollup(a), R.rollup(b))
    whole = a.union(b)

    def close(df):
        return [
            tuple(round(v, 9) if isinstance(v, float) else v for v in row)
            for row in rows_of(df)
        ]

    for made, direct in (
        (R.channel_summary_of(rolled), G.channel_summary(whole)),
        (R.daily_summary_of(rolled), G.daily_summary(whole)),
        (R.metrics_of(rolled), M.campaign_metrics(whole)),
    ):
        assert made.columns == direct.columns
        assert made.dtypes == direct.dtypes
        assert close(made) == close(direct)


def test_new_rows_takes_each_key_of_a_batch_once(spark):
    batch = spark.createDataFrame(
        [(1, "b"), (2, "z"), (2, "y"), (3, "x"), (None, "n")], "k long, v string"
    )
    existing = spark.createDataFrame([(3, "old")], "k long, v string")
    assert rows_of(I.new_rows(batch, existing, ["k"], ["v"])) == [(1, "b"), (2, "y")]


def test_merge_new(spark):
    existing = spark.createDataFrame([(1, "old")], "k long, v string")
    new = spark.createDataFrame([("new", 1), ("b", 2), ("a", 2)], "v string, k long")
    merged = I.merge_new(existing, new, ["k"], ["v"])
    assert rows_of(merged) == [(1, "old"), (2, "a")]


def test_union_by_name_insists_on_the_same_columns(spark):
    left = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rows_of(I.union_by_name(left, left.select("b", "a"))) == [(1, 2), (1, 2)]
    with pytest.raises(AnalysisException):
        I.union_by_name(left, left.select("a")).collect()


def test_newer_than(spark):
    stamps = [dt.datetime(2026, 1, day) for day in (1, 2, 3)]
    df = spark.createDataFrame([(t,) for t in stamps], "ts timestamp")
    seen = df.where(F.col("ts") < F.lit(stamps[2]))
    assert I.newer_than(df, "ts", seen).count() == 1
    assert I.newer_than(df, "ts", df).count() == 0
    assert I.newer_than(df, "ts", df.limit(0)).count() == 3
    blank = spark.createDataFrame([(None,)], "ts timestamp")
    assert I.newer_than(df.union(blank), "ts", blank).count() == 4
    assert I.high_water_mark(blank, "ts").first()[0] is None


def gold_case(spark):
    rows = [
        campaign(Campaign_ID=1, Company=None, Impressions=10, Clicks=1),
        campaign(Campaign_ID=2, Date="n/a", Impressions=0, Conversion_Rate=0.5),
        campaign(Campaign_ID=3, Channel_Used=None, ROI=-1.0, Conversion_Rate=0.2),
    ]
    return silver_table(spark, rows)


def test_campaign_summary(spark):
    summary = G.campaign_summary(gold_case(spark), SPEC)
    assert summary.columns == [
        "Campaign_ID",
        "Campaign_Type",
        "Company",
        "Total_Impressions",
        "Total_Clicks",
        "Total_Engagement_Score",
        "Total_Acquisition_Cost",
        "Avg_Conversion_Rate",
        "Avg_ROI",
    ]
    by_key = {row.Campaign_ID: row for row in summary.collect()}
    assert by_key[1].Company == "Unknown"
    assert by_key[1].Avg_Conversion_Rate == pytest.approx(0.04)
    assert by_key[2].Avg_Conversion_Rate == 0.0
    assert by_key[3].Avg_ROI == -1.0


def test_weighted_average_weighs(spark):
    rows = [
        campaign(Conversion_Rate=0.1, Impressions=30),
        campaign(Conversion_Rate=0.5, Impressions=10),
    ]
    df = C.typed_rows(raw_table(spark, rows), SPEC)
    assert G.campaign_summary(df).first().Avg_Conversion_Rate == pytest.approx(0.2)


def test_channel_summary_names_missing_channels(spark):
    channels = {row[0] for row in G.channel_summary(gold_case(spark)).collect()}
    assert channels == {"Google Ads", "Unknown"}


def test_daily_summary_leaves_undated_rows_out(spark):
    daily = G.daily_summary(gold_case(spark), SPEC).collect()
    assert [(row.Date, row.Total_Clicks) for row in daily] == [
        (dt.date(2021, 1, 1), 507)
    ]


def test_gold_reads_text_dates_too(spark):
    raw = raw_table(spark, [campaign(Date="13-02-2021", Acquisition_Cost="1")])
    numeric = raw.withColumn("Acquisition_Cost", F.lit(1.0))
    assert G.daily_summary(numeric).first().Date == dt.date(2021, 2, 13)


def test_gold_is_stamped_once_per_run(spark):
    run_ts = dt.datetime(2026, 2, 2, 3, 4, 5, 678901, tzinfo=dt.UTC)
    summary = G.daily_summary(gold_case(spark), SPEC, run_ts)
    stamped = summary.select(F.unix_micros("aggregation_timestamp")).distinct().first()
    assert stamped[0] == 1770001445678901


def test_metrics_agree_with_sql(spark):
    rows = [
        campaign(Campaign_ID=1),
        campaign(Campaign_ID=2, ROI=-3.0, Conversion_Rate=0.2, Impressions=0),
        campaign(Campaign_ID=3, ROI=0.0, Conversion_Rate=0.10),
        campaign(Campaign_ID=4, Campaign_Type=None, ROI=-0.5, Conversion_Rate=0.05),
    ]
    silver = silver_table(spark, rows)
    run_ts = dt.datetime(2026, 2, 2, tzinfo=dt.UTC)
    frame = M.campaign_metrics(silver, run_ts)
    text = M.campaign_metrics_sql(silver, run_ts)
    assert frame.columns == text.columns
    assert len(frame.columns) == 10
    assert rows_of(frame) == rows_of(text)
    by_type = {row.Campaign_Type: row for row in frame.collect()}
    assert by_type["Email"].Total_Campaigns == 3
    assert by_type["Email"].High_Performing_Count == 1
    assert by_type["Email"].High_Risk_Count == 1
    assert by_type["Email"].Avg_Adjusted_ROI == pytest.approx((5 - 1 + 0) / 3)
    assert by_type[None].High_Risk_Count == 1
    view = spark.sql(f"SELECT count(*) FROM {M.METRICS_VIEW}")
    assert view.first()[0] == 4


def test_metrics_sql_on_null_figures(spark):
    df = spark.createDataFrame(
        [("A", None, 10, None, None), ("A", 5, None, 0.2, 7.0), ("A", 5, 10, None, None)],
        "Campaign_Type string, Clicks int, Impressions int, Conversion_Rate double, ROI double",
    )
    assert rows_of(M.campaign_metrics(df)) == rows_of(M.campaign_metrics_sql(df))


def test_update_metrics(spark):
    schema = "Campaign_Type string, Total_Campaigns long"
    existing = spark.createDataFrame([("A", 1), (None, 1)], schema)
    fresh = spark.createDataFrame([("A", 9), ("B", 2), (None, 9)], schema)
    assert rows_of(M.update_metrics(existing, fresh)) == rows_of(fresh)
    kept = rows_of(M.update_metrics(existing, fresh, "insert_only"))
    assert kept == rows_of(existing.union(fresh.where("Campaign_Type = 'B'")))
    with pytest.raises(ValueError):
        M.update_metrics(existing, fresh, "replace")


def test_negative_costs_are_found_in_currency_text(spark):
    rows = [campaign(), campaign(Acquisition_Cost="$-5.00"), campaign(Acquisition_Cost="?")]
    found = Q.negative_counts(raw_table(spark, rows), ["Acquisition_Cost", "ROI"])
    assert rows_of(found) == [("Acquisition_Cost", 1), ("ROI", 0)]


def test_duplicate_keys_count_the_null_key(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k long")
    assert rows_of(Q.duplicate_keys(df, ["k"])) == [(1, 2), (None, 2)]


def test_distinct_counts_count_null(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), ("a", "x")], "p string, q string")
    expected = [("p", 2), ("q", 2)]
    assert rows_of(Q.distinct_counts(df, ["p", "q"])) == expected
    assert rows_of(Q.distinct_counts(df, ["p", "q"], approximate=True)) == expected
    assert rows_of(Q.distinct_values(df, ["p", "q"])) == sorted(
        [("p", "a"), ("p", "b"), ("q", None), ("q", "x")], key=repr
    )


def test_validation_checks_each_column_by_its_own_count(spark):
    """The conversion check must not follow the click-through check."""
    rows = [campaign(Campaign_ID=1, Clicks=3000), campaign(Campaign_ID=2)]
    silver = silver_table(spark, rows)
    report = Q.validate(silver, G.gold(silver, SPEC), SPEC)
    found = {(row["check"], row.column): row for row in report.collect()}
    assert found["unit_range", "CTR"].violations == 1
    assert not found["unit_range", "CTR"].passed
    assert found["unit_range", "Conversion_Rate"].passed
    assert len(found) == 3 + 6 + 2 + 3 * 2


def test_reconciliation_covers_undated_rows(spark):
    rows = [campaign(Campaign_ID=1), campaign(Campaign_ID=2, Date="n/a")]
    silver = silver_table(spark, rows)
    gold = G.gold(silver, SPEC)
    simple = {r.metric: r.matches for r in Q.reconcile(silver, gold["daily_summary"]).collect()}
    assert simple == {"Clicks": False, "Impressions": False}
    full = {
        (r.table, r.scope): r.matches
        for r in Q.reconcile_gold(silver, gold, SPEC).where("metric = 'Clicks'").collect()
    }
    assert full == {
        ("campaign_summary", "all"): True,
        ("channel_summary", "all"): True,
        ("daily_summary", "all"): False,
        ("daily_summary", "dated"): True,
    }
    assert Q.validate(silver, gold, SPEC).where("NOT passed").count() == 0


def test_a_wrong_total_fails_validation(spark):
    silver = silver_table(spark, [campaign()])
    gold = G.gold(silver, SPEC)
    off = gold["channel_summary"].withColumn("Total_Clicks", F.col("Total_Clicks") + 1)
    report = Q.validate(silver, {**gold, "channel_summary": off}, SPEC)
    failed = report.where("NOT passed").collect()
    assert [(r["check"], r.column) for r in failed] == [
        ("totals_channel_summary", "Clicks")
    ]


def test_validation_of_an_empty_table_passes(spark):
    silver = silver_table(spark, [])
    report = Q.validate(silver, G.gold(silver, SPEC), SPEC)
    assert report.where("NOT passed").count() == 0
    assert report.where("violations IS NULL").count() == 0


def test_profile_parts(spark):
    rows = [campaign(Campaign_ID=1), campaign(Campaign_ID=1, ROI=-1.0, Company=None)]
    found = Q.profile(raw_table(spark, rows), SPEC)
    counts = {(r["check"], r.column): r.value for r in found["counts"].collect()}
    assert counts["rows", "*"] == 2
    assert counts["nulls", "Company"] == 1
    assert counts["negatives", "ROI"] == 1
    assert counts["any_negative", "*"] == 1
    assert rows_of(found["duplicates"]) == [(1, 2)]
    assert found["invalid_sample"].count() == 1
    assert found["sample"].count() == 2
    assert found["schema"].count() == 16


def test_null_audit_and_row_delta(spark):
    raw = raw_table(spark, [campaign(Date="n/a"), campaign(Campaign_ID=None)])
    audit = Q.null_audit(raw, ["Campaign_ID", "Date"], {"Date": C.typed_date(raw)})
    assert rows_of(audit) == [("Campaign_ID", 1, 1), ("Date", 0, 1)]
    assert rows_of(Q.row_delta(raw, raw.limit(0))) == [(2, 0, 2)]


def test_operators_leave_the_session_alone(spark):
    setting = "spark.sql.parquet.enableVectorizedReader"
    before = spark.conf.get(setting)
    spark.catalog.clearCache()
    kept = spark.range(3).cache()
    silver = silver_table(spark, [campaign()])
    for report in Q.profile(raw_table(spark, [campaign()]), SPEC).values():
        report.collect()
    Q.validate(silver, G.gold(silver, SPEC), SPEC).collect()
    assert spark.conf.get(setting) == before
    assert kept.is_cached
    kept.unpersist()


def test_another_spec(spark):
    """Nothing in the operators is tied to the default channel list."""
    spec = CampaignSpec(channels=("Radio",))
    rows = [campaign(), campaign(Campaign_ID=2, Channel_Used="Radio")]
    kept = C.business_filter(silver_table(spark, rows), spec)
    assert [row.Campaign_ID for row in kept.collect()] == [2]
