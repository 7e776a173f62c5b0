"""What the physical plans must look like to hold at scale."""

import contextlib
import datetime as dt
import io
import re

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from adlake.operators import clean as C
from adlake.operators import gold as G
from adlake.operators import incremental as I
from adlake.operators import metrics as M
from adlake.operators import quality as Q
from adlake.sources import Lake
from adlake.sources.readers import stamp, to_micros
from checks import QUERIES, feed
from checks.feed import SPEC

RUN = dt.datetime(2026, 2, 2, tzinfo=dt.UTC)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df):
    """The plan with the attributes of its scans in full."""
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def shuffles(text):
    return len(re.findall(r"Exchange hashpartitioning", text))


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    lake = Lake(spark, str(tmp_path_factory.mktemp("lake")))
    raw = stamp(feed.campaigns(spark, "/root/testdata/sf0.001"), "ingestion_timestamp", RUN)
    mark = to_micros(RUN)
    bronze = lake.replace("bronze", raw, mark)
    silver = lake.replace("silver", C.clean(bronze, SPEC), mark)
    lake.replace("filtered", C.business_filter(silver, SPEC), mark)
    return lake


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_clean_is_one_shuffle_with_a_limit_on_the_map_side(lake):
    text = plan(C.clean(lake.read("bronze"), SPEC))
    assert shuffles(text) == 1
    assert re.search(r"WindowGroupLimit .*Partial", text)
    assert "IsNotNull(Campaign_ID)" in text
    below = text[text.index("Exchange hashpartitioning") :]
    assert "try_to_date" not in below and "translate" not in below


def test_layer_passes_the_filter_of_a_large_batch_before_its_shuffle(spark, lake, no_broadcast):
    """Of the stored side only what may be met is shuffled; so much less, the smaller the batch."""
    stored = lake.read("silver")
    shuffled = []
    for share in (0.5, 0.01):
        batch = feed.campaigns(spark, "/root/testdata/sf0.001").sample(share, 3)
        measured = I.measure_keys(batch, SPEC.keys, broadcast_bytes=0)
        text = plan(I.unseen_rows(batch, stored, SPEC.keys, measured))
        side = text[text.rindex("BroadcastHashJoin") :]
        assert "LeftSemi" in side.split("\n")[0] and "Campaign_ID" in side
        assert re.search(r"SortMergeJoin|ShuffledHashJoin", text[: text.rindex("BroadcastHashJoin")])
        assert text.index("Exchange hashpartitioning(Campaign_ID") < text.rindex("BroadcastHashJoin")
        shuffled.append(I.may_be_in(stored, SPEC.keys, measured.filter).count())
    assert shuffled[1] < 0.1 * shuffled[0] and shuffled[0] < stored.count()


def test_business_filter_reaches_the_scan(lake):
    text = formatted(C.business_filter(lake.read("silver"), SPEC))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    for part in ("GreaterThan(Impressions,0)", "In(Channel_Used", "Or(", "Acquisition_Cost"):
        assert part in pushed
    assert "Exchange" not in text


def test_marks_reach_the_scan(spark, lake):
    text = plan(I.ingested_after(lake.read("bronze"), to_micros(RUN)))
    assert "GreaterThan(ingestion_timestamp,2026-02-02" in text
    events = feed.table(spark, "/root/testdata/sf0.001", "events")
    text = plan(I.newer_than(events, "ts", events.where("ts < '2024-01-10'")))
    assert "GreaterThan(ts,ScalarSubquery" in text


def test_metrics_read_five_columns_and_shuffle_groups(lake):
    for table in (
        M.campaign_metrics(lake.read("filtered")),
        M.campaign_metrics_sql(lake.read("filtered")),
    ):
        text = plan(table)
        read = re.search(r"ReadSchema: struct<(.*?)>", formatted(table)).group(1)
        assert {c.split(":")[0] for c in read.split(",")} == {
            "Campaign_Type",
            "Clicks",
            "Impressions",
            "Conversion_Rate",
            "ROI",
        }
        assert shuffles(text) == 1
        assert "partial_avg" in text


@pytest.mark.parametrize("name", ["campaign_summary", "channel_summary", "daily_summary"])
def test_gold_is_one_partial_and_one_final_aggregate(lake, name):
    text = plan(G.gold(lake.read("filtered"), SPEC)[name])
    assert shuffles(text) == 1
    assert text.count("HashAggregate") == 2
    assert "SortAggregate" not in text
    assert "Customer_Segment" not in text


def test_increment_of_a_large_batch_is_two_shuffles(lake, no_broadcast):
    batch, stored = lake.read("bronze"), lake.read("silver")
    fresh = I.new_rows(batch, stored, SPEC.keys, SPEC.tie_break)
    text = plan(fresh)
    assert shuffles(text) == 2
    assert "SortMergeJoin" in text and "LeftAnti" in text
    assert "partial" in text or text.count("HashAggregate") == 2


def test_increment_of_a_small_batch_does_not_shuffle_the_layer(lake, no_broadcast):
    batch, stored = lake.read("bronze"), lake.read("silver")
    measured = I.measure_keys(batch, SPEC.keys)
    text = plan(I.unseen_rows(batch, stored, SPEC.keys, measured))
    semi = text.index("LeftSemi")
    assert "BroadcastHashJoin" in text[semi - 80 : semi]
    scans_below_semi = text[semi:]
    assert "Exchange hashpartitioning" not in scans_below_semi
    assert "GreaterThanOrEqual(Campaign_ID" in text and "LessThanOrEqual" in text


def test_validation_scans_the_filtered_rows_once(lake):
    silver = lake.read("filtered")
    gold = {
        name: lake.replace(name, df, 1) for name, df in G.gold(silver, SPEC).items()
    }
    text = plan(Q.validate(silver, gold, SPEC))
    assert len(re.findall(r"FileScan.*/filtered", text)) == 1


def test_the_profile_is_two_scans(lake):
    """One for all counts, one for the groups that everything else is made of."""
    written = []

    def stored(groups):
        written.append(plan(groups))
        return lake.replace("groups", groups, 1)

    bronze = lake.read("bronze")
    found = Q.profile(bronze, SPEC, stored=stored)
    assert [text.count("FileScan") for text in (plan(found["counts"]), *written)] == [1, 1]
    assert written[0].count("Expand") == 1 and shuffles(written[0]) == 1
    for name in ("duplicates", "distinct_values", "distinct_counts"):
        scans = re.findall(r"FileScan.*?Location: [^,]*", plan(found[name]))
        assert len(scans) == 1 and "/groups" in scans[0]


def test_the_profile_agrees_with_its_parts(lake):
    bronze = lake.read("bronze")
    found = Q.profile(bronze, SPEC)
    for name, alone in (
        ("duplicates", Q.duplicate_keys(bronze, SPEC.keys)),
        ("distinct_values", Q.distinct_values(bronze, SPEC.profiled_dimensions)),
        ("distinct_counts", Q.distinct_counts(bronze, SPEC.profiled_dimensions)),
    ):
        assert rows_of(found[name]) == rows_of(alone) != []


def test_nothing_of_an_old_batch_is_shuffled(lake, no_broadcast):
    batch, stored = lake.read("bronze"), lake.read("silver")
    measured = I.measure_keys(batch, SPEC.keys)
    text = plan(I.new_rows(batch, stored, SPEC.keys, SPEC.tie_break, measured))
    above, below = text.split("LeftAnti", 1)
    assert "BroadcastHashJoin" in above[-80:] or "BroadcastHashJoin" in above
    streamed = below[: below.index("BroadcastExchange")]
    assert "FileScan" in streamed and "Exchange hashpartitioning" not in streamed
    assert shuffles(above) == 1, "only rows with new keys are sorted out by key"


def test_rows_with_new_keys_are_cleaned_without_a_shuffle(lake):
    assert "Exchange" not in plan(C.clean(lake.read("bronze"), SPEC, unique=True))


def test_quarantine_and_runs_are_partitions(spark, tmp_path):
    from samples import campaign, raw_table

    from adlake.plans import run_increment, stages

    run_increment(spark, raw_table(spark, [campaign()]), str(tmp_path), run_ts=RUN)
    own = Lake(spark, str(tmp_path))
    for rows in (stages.bronze_rows(own), stages.quarantine(own)):
        filters = re.search(r"PartitionFilters: \[[^]]*", formatted(rows)).group()
        assert "quarantined" in filters and "version" in filters


def test_profile_counts_are_one_pass(lake):
    text = plan(Q.profile_counts(lake.read("bronze"), SPEC.measures, SPEC))
    assert text.count("FileScan") == 1
    assert shuffles(text) == 0


# Queries that hold data written by their own runs are judged by the tests above.
LAZY = sorted(
    set(QUERIES)
    - {
        "increment_two_batches",
        "stream_increment",
        "full_pipeline",
        "is_non_empty",
    }
)


@pytest.mark.parametrize("name", LAZY)
def test_no_query_leaves_the_engine_or_multiplies_rows(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for word in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_hot_key_sends_one_row_per_task(spark):
    """A third of all rows share a key; the map side keeps one of them each."""
    df = spark.range(0, 30000, 1, 6).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id"
    )
    kept = C.first_per_key(df, ["k"], ["id"])
    assert kept.count() == 20001
    assert kept.where("k = -1").first().id == 0
    assert re.search(r"WindowGroupLimit .*Partial", plan(kept))
