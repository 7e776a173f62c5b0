"""Whole runs: invariants of the incremental load, recovery, full run, stream."""

import datetime as dt
import shutil
from dataclasses import replace
from functools import partial

import pytest
from pyspark.sql import functions as F
from conftest import rows_of
from samples import campaign, raw_table

from adlake import __main__ as cli
from adlake.operators import gold as G
from adlake.operators.clean import business_filter, clean
from adlake.operators.metrics import campaign_metrics
from adlake.operators.incremental import measure_keys, unseen_rows
from adlake.plans import increment, run_full, run_increment, stages
from adlake.plans.increment import extend_bronze
from adlake.sources import Lake
from adlake.spec import AUDIT_COLUMNS, DEFAULT_SPEC, RAW_SCHEMA
from adlake.streaming import run_stream
from checks import feed
from checks import runs as checked_runs

START = dt.datetime(2026, 2, 2, tzinfo=dt.UTC)
TABLES = (
    "silver",
    "filtered",
    "campaign_summary",
    "channel_summary",
    "daily_summary",
    "sql_metrics",
)
CHANNELS = ("YouTube", "Email", "Radio", None, "Facebook")
DAYS = ("2021-01-01", "02-01-2021", "01/03/2021", "n/a")


def hour(n):
    return START + dt.timedelta(hours=n)


def rows_from(first, last):
    return [
        campaign(
            Campaign_ID=None if i % 10 == 9 else i,
            Channel_Used=CHANNELS[i % len(CHANNELS)],
            Date=DAYS[i % len(DAYS)],
            Clicks=i,
            Impressions=i * 10,
            Campaign_Type="Email" if i % 2 else "Search",
            Company=f"company {i % 3}",
        )
        for i in range(first, last)
    ]


BATCH_1 = rows_from(0, 40)
BATCH_2 = rows_from(20, 60)
BATCH_3 = rows_from(55, 70)
EVERYTHING = rows_from(0, 70)


def content(df):
    dropped = (*AUDIT_COLUMNS, "Latest_Metrics_Timestamp")
    plain = df.drop(*dropped)
    rows = (
        tuple(round(v, 9) if isinstance(v, float) else v for v in row)
        for row in rows_of(plain.select(*sorted(plain.columns)))
    )
    return sorted(rows, key=repr)


def lake_content(spark, root):
    lake = Lake(spark, root)
    return {name: content(lake.read(name)) for name in TABLES}


def expected_content(spark, rows):
    filtered = business_filter(clean(raw_table(spark, rows)))
    tables = {
        "silver": clean(raw_table(spark, rows)),
        "filtered": filtered,
        "sql_metrics": campaign_metrics(filtered),
        **G.gold(filtered),
    }
    return {name: content(tables[name]) for name in TABLES}


@pytest.fixture(scope="module")
def expected(spark):
    return expected_content(spark, EVERYTHING)


def load(spark, rows, root, n):
    counts = run_increment(spark, raw_table(spark, rows), root, run_ts=hour(n))
    return {(r.stage, r.metric): r.value for r in counts.collect()}


@pytest.fixture(scope="module")
def first_lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("first") / "lake")
    first = load(spark, BATCH_1, root, 0)
    assert first["bronze", "rows_added"] == 40
    return root


@pytest.fixture
def root(first_lake, tmp_path):
    """A lake of its own that holds the first batch."""
    return shutil.copytree(first_lake, str(tmp_path / "lake"))


def test_increments_equal_one_full_load(spark, root, expected):
    second = load(spark, BATCH_2, root, 1)
    assert second["bronze", "rows_received"] == 40
    assert second["bronze", "rows_added"] == 18
    assert second["silver", "rows_added"] == 18
    again = load(spark, BATCH_1, root, 2)
    assert [again[key] for key in again if key[1] == "rows_added"] == [0, 0, 0]
    load(spark, BATCH_3, root, 3)
    assert lake_content(spark, root) == expected


def test_a_repeated_batch_rewrites_no_table(spark, root):
    before = Lake(spark, root).state()
    load(spark, BATCH_1, root, 1)
    after = Lake(spark, root).state()
    assert {name: after[name] for name in TABLES} == {name: before[name] for name in TABLES}


def test_run_times_must_rise(spark, root):
    with pytest.raises(ValueError, match="run_ts"):
        load(spark, BATCH_2, root, 0)


def test_no_run_may_go_back_in_time(spark, root, tmp_path):
    """Rows stamped before a layer's mark would be overlooked or counted twice."""
    write_raw(spark, BATCH_2, str(tmp_path / "raw"))
    for run in (run_full, run_stream):
        with pytest.raises(ValueError, match="run_ts"):
            run(spark, str(tmp_path / "raw"), root, run_ts=hour(-1))


def test_a_lake_takes_streams_or_batches(spark, root, tmp_path):
    raw, other = str(tmp_path / "raw"), str(tmp_path / "streamed")
    write_raw(spark, BATCH_2, raw)
    with pytest.raises(ValueError, match="batches"):
        run_stream(spark, raw, root, run_ts=hour(1))
    run_stream(spark, raw, other, run_ts=hour(1))
    with pytest.raises(ValueError, match="stream"):
        load(spark, BATCH_3, other, 2)


def test_batch_with_nothing_for_the_filter(spark, root):
    dull = [campaign(Campaign_ID=1000 + i, Channel_Used="Radio") for i in range(3)]
    counts = load(spark, dull, root, 1)
    assert counts["silver", "rows_added"] == 3
    assert counts["filtered", "rows_added"] == 0
    load(spark, BATCH_2, root, 2)
    assert lake_content(spark, root) == expected_content(spark, BATCH_1 + dull + BATCH_2)


def test_empty_first_batch(spark, tmp_path, expected):
    root = str(tmp_path)
    load(spark, [], root, 0)
    assert all(rows == [] for rows in lake_content(spark, root).values())
    load(spark, EVERYTHING, root, 1)
    assert lake_content(spark, root) == expected


def test_run_that_died_after_bronze_is_made_good(spark, root, expected):
    extend_bronze(Lake(spark, root), raw_table(spark, BATCH_2), DEFAULT_SPEC, hour(1))
    load(spark, BATCH_3, root, 2)
    assert lake_content(spark, root) == expected


@pytest.mark.parametrize("layer", ["bronze", "silver", "filtered", "campaign_summary"])
def test_run_that_died_amid_an_append_is_made_good(
    spark, root, expected, monkeypatch, layer
):
    """Half of the rows got there, the commit did not."""
    whole = Lake.append

    def half(self, name, df, mark, parts=()):
        if name != layer:
            return whole(self, name, df, mark, parts)
        part = df.where("Campaign_ID % 2 = 0").select(*self.read(name).columns)
        target = self.path(name, self.state()[name].version + 1)
        part.write.mode("append").partitionBy(*parts).parquet(target)
        raise RuntimeError("executor and driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(Lake, "append", half)
        with pytest.raises(RuntimeError):
            load(spark, BATCH_2, root, 1)
    if layer == "bronze":
        load(spark, BATCH_2, root, 2)
    load(spark, BATCH_3, root, 3)
    assert lake_content(spark, root) == expected


def test_run_that_died_before_the_gold_commit_is_made_good(
    spark, root, expected, monkeypatch
):

    def die(self, tables, mark):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Lake, "replace_all", die)
        with pytest.raises(RuntimeError):
            load(spark, BATCH_2, root, 1)
    load(spark, BATCH_2, root, 2)
    load(spark, BATCH_3, root, 3)
    assert lake_content(spark, root) == expected


def test_a_large_batch_is_joined_by_shuffle_with_the_same_result(
    spark, root, expected, monkeypatch
):
    monkeypatch.setattr("adlake.operators.incremental.BROADCAST_BYTES", 0)
    for n, batch in enumerate((BATCH_2, BATCH_3), start=1):
        load(spark, batch, root, n)
    assert lake_content(spark, root) == expected


def test_metrics_insert_only_keeps_known_types(spark, tmp_path):
    root = str(tmp_path)
    first = [row for row in BATCH_1 if row["Campaign_Type"] == "Email"]
    run_increment(spark, raw_table(spark, first), root, run_ts=hour(0))
    old = content(Lake(spark, root).read("sql_metrics"))
    run_increment(
        spark, raw_table(spark, BATCH_2), root, run_ts=hour(1), metrics_mode="insert_only"
    )
    new = content(Lake(spark, root).read("sql_metrics"))
    assert len(old) == 1 and len(new) == 2
    assert old[0] in new


def write_raw(spark, rows, path):
    raw_table(spark, rows).coalesce(1).write.option("header", True).csv(path)


def test_full_run(spark, tmp_path, expected):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "lake")
    write_raw(spark, EVERYTHING, raw)
    made = run_full(spark, raw, root, run_ts=hour(0))
    assert {name: content(made[name]) for name in TABLES} == expected
    assert made["bronze"].count() == len(EVERYTHING)
    assert made["bronze"].where("source_file LIKE '%.csv'").count() == len(EVERYTHING)
    assert made["schema"].count() == 16
    assert made["validation"].where("NOT passed").count() == 0
    totals = made["sql_metrics"].groupBy().sum("Total_Campaigns", "Total_Clicks").first()
    clicks = made["filtered"].groupBy().sum("Clicks").first()[0]
    assert tuple(totals) == (made["filtered"].count(), clicks)


def test_full_run_again_and_followed_by_an_increment(spark, tmp_path, expected):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "lake")
    write_raw(spark, BATCH_1, f"{raw}/a")
    run_full(spark, f"{raw}/*", root, run_ts=hour(0))
    write_raw(spark, [r for r in EVERYTHING if r not in BATCH_1], f"{raw}/b")
    made = run_full(spark, f"{raw}/*", root, run_ts=hour(1), then_increment=True)
    assert {name: content(made[name]) for name in TABLES} == expected
    assert made["bronze"].count() == len(EVERYTHING)


def write_broken(spark, path, *rows):
    write_raw(spark, list(rows), path)
    spark.createDataFrame([(",".join(RAW_SCHEMA.names),), ("77,too short",)], "value string").coalesce(1).write.mode(
        "append"
    ).text(path)


def quarantined(spark, root):
    found = stages.validate_gold(Lake(spark, root)).where("check = 'quarantined'").first()
    return found.violations, found.passed


def test_corrupt_records_go_to_quarantine_once_and_fail_validation(spark, root, tmp_path):
    raw, lake = str(tmp_path / "raw"), Lake(spark, root)
    assert quarantined(spark, root) == (0, True)
    write_broken(spark, raw, campaign(Campaign_ID=500))
    for n in (1, 2):
        counts = run_increment(spark, stages.raw_rows(lake, raw), root, run_ts=hour(n))
        counts = {(r.stage, r.metric): r.value for r in counts.collect()}
        assert counts["bronze", "rows_received"] == 2
        assert counts["bronze", "rows_added"] == counts["bronze", "rows_quarantined"] == (n == 1)
    assert quarantined(spark, root) == (1, False)
    assert [row.corrupt_record for row in stages.quarantine(Lake(spark, root)).collect()] == ["77,too short"]
    # Put right and sent again, the record is new.
    load(spark, [campaign(Campaign_ID=77)], root, 3)
    silver = Lake(spark, root).read("silver")
    assert silver.where("Campaign_ID IN (77, 500)").count() == 2 and "corrupt_record" not in silver.columns


@pytest.mark.parametrize("run", [run_full, run_stream])
def test_whole_runs_set_corrupt_records_apart(spark, tmp_path, run):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "lake")
    write_broken(spark, raw, campaign(Campaign_ID=1, Clicks=3, Impressions=9))
    made = run(spark, raw, root, run_ts=hour(0))
    assert quarantined(spark, root) == (1, False)
    assert Lake(spark, root).read("silver").count() == 1
    if run is run_full:
        assert made["quarantine"].first().quarantined == 1
        counts = {(r.stage, r.metric): r.value for r in made["row_counts"].collect()}
        assert counts["bronze", "rows_quarantined"] == 1 and counts["filtered", "rows_stored"] == 1
        assert rows_of(made["null_audit"]) == [("Campaign_ID", 0, 0), ("Date", 0, 0)]
        assert {f"report_{name}" for name in ("schema", "validation", "profile_counts")} <= Lake(spark, root).state().keys()
        with pytest.raises(SystemExit, match="quarantine"):
            cli.refuse_corrupt(Lake(spark, root))


def test_a_new_column_is_carried_through_the_layers(spark, root):
    batch = raw_table(spark, [campaign(Campaign_ID=900)]).withColumn("Budget", F.lit(7.5))
    run_increment(spark, batch, root, run_ts=hour(1))
    for layer in ("bronze", "silver", "filtered"):
        rows = Lake(spark, root).read(layer)
        assert rows.where("Campaign_ID = 900").first().Budget == 7.5
        assert rows.where("Budget IS NOT NULL").count() == 1 < rows.count()


def test_after_a_second_full_run_filtered_rows_are_looked_up_again(spark, tmp_path):
    """Filtered keeps keys that the new raw files lack, so new ones may be known to it."""
    root = str(tmp_path / "lake")
    write_raw(spark, BATCH_1, f"{tmp_path}/one")
    run_full(spark, f"{tmp_path}/one", root, run_ts=hour(0))
    write_raw(spark, rows_from(60, 70), f"{tmp_path}/two")
    run_full(spark, f"{tmp_path}/two", root, run_ts=hour(1))
    load(spark, BATCH_1, root, 2)
    filtered = Lake(spark, root).read("filtered")
    assert filtered.count() == filtered.select("Campaign_ID").distinct().count()
    assert stages.validate_gold(Lake(spark, root)).where("check LIKE 'totals%' AND NOT passed").isEmpty()


def test_command_line(spark, tmp_path, capsys):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "lake")
    write_raw(spark, BATCH_1, f"{raw}/a")
    cli.main(["full", f"{raw}/*", root])
    write_raw(spark, BATCH_2, f"{raw}/b")
    cli.main(["increment", f"{raw}/b", root])
    cli.main(["validate", root])
    cli.main(["profile", root, str(tmp_path / "profile")])
    cli.main(["read", f"{raw}/b", "--format", "csv", "--rows", "2"])
    shown = capsys.readouterr().out
    for word in ("totals_daily_summary", "rows_added", "layer_empty", "row_json"):
        assert word in shown
    assert spark.read.parquet(str(tmp_path / "profile" / "distinct_counts")).count() > 0
    merged = expected_content(spark, BATCH_1 + BATCH_2)
    assert lake_content(spark, root) == merged


def test_stages_of_an_empty_lake_yield_empty_tables(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    assert stages.refine(lake, START).isEmpty()
    assert stages.select_business(lake, START).isEmpty()
    assert stages.measure(Lake(spark, str(tmp_path / "none")), START).isEmpty()
    failed = stages.validate_gold(lake).where("NOT passed").select("check", "column")
    empty = {("layer_empty", "silver"), ("layer_empty", "filtered")}
    absent = {("table_absent", f"{name}_summary") for name in ("campaign", "channel", "daily")}
    assert set(map(tuple, failed.collect())) == empty | absent
    assert stages.profile_bronze(lake)["counts"].first().value == 0
    made = stages.summarise(lake, START)
    assert all(table.isEmpty() for table in made.values())
    checks = stages.validate_gold(lake)
    assert checks.count() == 23
    assert set(map(tuple, checks.where("NOT passed").select("check", "column").collect())) == empty


def test_metrics_stage_on_its_own(spark, root):
    lake = Lake(spark, root)
    before = content(lake.read("sql_metrics"))
    assert content(stages.measure(lake, hour(5))) == before


def test_full_run_raises_what_goes_wrong(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        run_full(spark, str(tmp_path / "none"), str(tmp_path / "lake"))


def test_stream_takes_each_file_once(spark, tmp_path, expected):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "lake")
    write_raw(spark, BATCH_1, f"{raw}/a")
    assert run_stream(spark, f"{raw}/*", root, run_ts=hour(0))["silver"] == 36
    assert run_stream(spark, f"{raw}/*", root, run_ts=hour(1))["silver"] == 0
    write_raw(spark, BATCH_2, f"{raw}/b")
    write_raw(spark, BATCH_3, f"{raw}/c")
    run_stream(spark, f"{raw}/*", root, run_ts=hour(2))
    assert lake_content(spark, root) == expected
    streamed = spark.read.parquet(f"{root}/bronze_stream")
    assert streamed.count() == len(BATCH_1 + BATCH_2 + BATCH_3)


def test_a_resummary_stamped_between_increments_counts_nothing_twice(spark, tmp_path, expected):
    root = str(tmp_path / "lake")
    run_increment(spark, raw_table(spark, BATCH_1), root, run_ts=hour(0))
    run_increment(spark, raw_table(spark, BATCH_2), root, run_ts=hour(2))
    stages.summarise(Lake(spark, root), hour(1))
    run_increment(spark, raw_table(spark, BATCH_3), root, run_ts=hour(3))
    assert lake_content(spark, root) == expected
    assert stages.validate_gold(Lake(spark, root)).where("NOT passed").isEmpty()


def test_marks_never_fall(spark, tmp_path):
    root = str(tmp_path / "lake")
    run_increment(spark, raw_table(spark, BATCH_1), root, run_ts=hour(2))
    lake = Lake(spark, root)
    with pytest.raises(ValueError, match="beyond"):
        lake.advance("filtered", 0)
    with pytest.raises(ValueError, match="beyond"):
        lake.replace("silver", lake.read("silver"), 0)


def test_full_run_leaves_a_stream_fed_lake_alone(spark, tmp_path):
    raw, root = str(tmp_path / "raw"), str(tmp_path / "lake")
    write_raw(spark, BATCH_1, f"{raw}/a")
    run_stream(spark, f"{raw}/*", root, run_ts=hour(0))
    with pytest.raises(ValueError, match="stream"):
        run_full(spark, f"{raw}/*", root, run_ts=hour(1))


def test_campaign_table_under_other_keys_equals_one_load(spark, tmp_path):
    spec = replace(DEFAULT_SPEC, keys=("Campaign_ID", "Date"))
    days = [campaign(Campaign_ID=2, Date=day, Clicks=5, Impressions=10) for day in ("2021-01-01", "2021-01-02")]
    for i, day in enumerate(days):
        run_increment(spark, raw_table(spark, [day]), str(tmp_path / "two"), spec, hour(i))
    run_increment(spark, raw_table(spark, days), str(tmp_path / "one"), spec, hour(0))
    two, one = (content(Lake(spark, str(tmp_path / name)).read("campaign_summary")) for name in ("two", "one"))
    assert two == one
    assert Lake(spark, str(tmp_path / "two")).read("campaign_summary").first().Total_Clicks == 10


def test_unique_rows_are_summed_up_without_a_shuffle(spark):
    rows = business_filter(clean(raw_table(spark, EVERYTHING)))
    alone = G.campaign_summary(rows, unique=True)
    assert alone.dtypes == G.campaign_summary(rows).dtypes
    assert content(alone) == content(G.campaign_summary(rows))
    given = spark.createDataFrame(rows.collect(), rows.schema)
    plan = G.campaign_summary(given, unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_keys_are_broadcast_only_up_to_the_limit_and_rows_agree(spark):
    batch, target = raw_table(spark, BATCH_2), raw_table(spark, BATCH_1)
    few, many = (measure_keys(batch, ["Campaign_ID"], limit) for limit in (1 << 20, 0))
    assert few.few is not None and many.few is None
    fresh = [unseen_rows(batch, target, ["Campaign_ID"], keys) for keys in (few, many)]
    assert rows_of(fresh[0]) == rows_of(fresh[1])


def test_a_batch_too_large_to_broadcast_moves_only_rows_of_unseen_keys(spark, tmp_path, monkeypatch):
    root, plain = f"{tmp_path}/large", f"{tmp_path}/plain"
    batches = (BATCH_1, BATCH_2 + BATCH_2, BATCH_2, BATCH_3)
    for n, rows in enumerate(batches):
        run_increment(spark, raw_table(spark, rows), plain, run_ts=hour(n))
    monkeypatch.setattr(increment, "measure_keys", partial(measure_keys, broadcast_bytes=0))
    unseen = []
    for n, rows in enumerate(batches):
        run_increment(spark, raw_table(spark, rows), root, run_ts=hour(n))
        if n:
            unseen.append(sorted(r[0] for r in spark.read.parquet(f"{root}/staging_keys").collect()))
    keys = [{c["Campaign_ID"] for c in rows} - {None} for rows in batches]
    assert unseen == [sorted(keys[1] - keys[0]), [], sorted(keys[3] - keys[0] - keys[1])]
    for layer in ("silver", "filtered", "channel_summary"):
        names = sorted(Lake(spark, plain).read(layer).columns)
        found, expected = (rows_of(Lake(spark, at).read(layer).select(*names)) for at in (root, plain))
        assert found == expected


def test_raw_batches_are_joined_once_and_orders_meet_customers_first(spark, sf_dir):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    joins = [line for line in plan(feed.campaigns(spark, sf_dir)).splitlines() if "Join" in line]
    assert "l_orderkey" in joins[0] and len(joins) == 5
    assert all("Join" not in plan(batch) for batch in checked_runs.raw_batches(spark, sf_dir))
