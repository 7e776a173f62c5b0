"""Readers, sinks and the layer store."""

import datetime as dt
import json

import pytest
from conftest import rows_of
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from samples import campaign, raw_table

from adlake import RAW_SCHEMA
from adlake import sources as io
from adlake.sources import Lake, sinks
from adlake.spec import CORRUPT_RECORD, QUARANTINED


def write_csv(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


HEADER = ",".join(RAW_SCHEMA.names)
LINE = (
    '1,"Smith, Sons",Email,Men 18-24,30 days,Google Ads,0.04,"$16,174.00",6.29,'
    "Chicago,Spanish,506,1922,6,Health & Wellness,2021-01-01"
)


def test_csv_quotes_and_types(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [HEADER, LINE, "x" + LINE[1:].replace("506", "")])
    df = io.read_csv(spark, path)
    assert df.schema == RAW_SCHEMA
    first, second = df.orderBy(F.desc("Campaign_ID")).collect()
    assert first.Company == "Smith, Sons"
    assert first.Acquisition_Cost == "$16,174.00"
    assert second.Campaign_ID is None
    assert second.Clicks is None


def test_date_column_stays_text_whatever_files_are_there(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [HEADER, LINE])
    inferred = io.read_csv(spark, str(tmp_path), schema=None)
    assert inferred.schema["Date"].dataType == T.DateType()
    write_csv(tmp_path / "b.csv", [HEADER, LINE.replace("2021-01-01", "13-02-2021")])
    assert io.read_csv(spark, str(tmp_path)).schema["Date"].dataType == T.StringType()


def test_csv_with_another_header_is_refused(spark, tmp_path):
    swapped = HEADER.replace("Clicks,Impressions", "Impressions,Clicks")
    path = write_csv(tmp_path / "a.csv", [swapped, LINE])
    with pytest.raises(Exception, match="header"):
        io.read_csv(spark, path).collect()


def test_json_lines_with_differing_fields(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"a": 1}) + "\n" + json.dumps({"b": "x", "a": 2}) + "\n")
    assert rows_of(io.read_json(spark, str(path))) == [(1, None), (2, "x")]
    narrow = io.read_json(spark, str(path), T.StructType.fromDDL("b string"))
    assert rows_of(narrow) == [("x",), (None,)]


def test_read_any_dispatches_and_refuses(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", ["k,v", "1,x"])
    assert rows_of(io.read_any(spark, path, "CSV")) == [(1, "x")]
    assert rows_of(io.read_any(spark, path, "csv", infer_schema=False)) == [("1", "x")]
    assert io.read_any(spark, path, "csv", header=False).count() == 2
    with pytest.raises(ValueError, match="orc"):
        io.read_any(spark, path, "orc")
    with pytest.raises(AnalysisException):
        io.read_any(spark, str(tmp_path / "missing"))


def test_read_report(spark):
    report = io.read_report(spark.range(20), show_rows=3)
    assert report["schema"].first().row_count == 20
    assert [r.row_json for r in report["sample"].collect()] == [
        '{"id":0}',
        '{"id":1}',
        '{"id":2}',
    ]


def test_read_or_empty(spark, tmp_path):
    schema = T.StructType.fromDDL("id long")
    assert not io.has_rows(io.read_or_empty(spark, str(tmp_path / "no"), schema))
    (tmp_path / "hollow").mkdir()
    hollow = io.read_or_empty(spark, str(tmp_path / "hollow"), schema)
    assert hollow.schema == schema and hollow.count() == 0
    io.overwrite(spark.range(2), str(tmp_path / "yes"))
    assert io.has_rows(io.read_or_empty(spark, str(tmp_path / "yes"), schema))
    with pytest.raises(ValueError):
        io.read_or_empty(spark, str(tmp_path / "yes"), schema, "xml")


def test_lineage(spark, tmp_path):
    write_csv(tmp_path / "one.csv", [HEADER, LINE])
    write_csv(tmp_path / "two.csv", [HEADER, LINE, LINE])
    bronze = io.with_lineage(io.read_csv(spark, str(tmp_path)))
    counts = bronze.groupBy(F.regexp_extract("source_file", "([^/]+)$", 1)).count()
    assert rows_of(counts) == [("one.csv", 1), ("two.csv", 2)]


def test_stamp_is_the_same_in_every_derived_query(spark):
    run_ts = dt.datetime(2026, 2, 2, 1, 2, 3, 4, tzinfo=dt.UTC)
    stamped = io.stamp(spark.range(3), "t", run_ts)
    again = stamped.where(F.col("t") > stamped.agg(F.max("t")).scalar())
    assert again.count() == 0
    micros = stamped.select(F.unix_micros("t").alias("m")).distinct().collect()
    assert [row.m for row in micros] == [io.readers.to_micros(run_ts)]
    naive = run_ts.replace(tzinfo=None)
    assert io.readers.to_micros(naive) == io.readers.to_micros(run_ts)


def test_append_creates_and_adds(spark, tmp_path):
    path = str(tmp_path / "t")
    io.append_rows(spark.range(2), path)
    io.append_rows(spark.range(3), path)
    assert io.read_parquet(spark, path).count() == 5
    io.overwrite(spark.range(1), path)
    assert io.read_parquet(spark, path).count() == 1


def test_typed_empty_keeps_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    io.overwrite(io.typed_empty(spark, RAW_SCHEMA), path)
    stored = io.read_parquet(spark, path)
    assert stored.schema == RAW_SCHEMA and stored.count() == 0


def test_shared_dir_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = io.shared_dir(spark, "x"), io.shared_dir(spark, "x")
    assert first != second
    if base:
        assert first.startswith(base)


def test_layer_is_replaced_from_itself(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    stored = lake.replace("t", spark.range(3), 1)
    for mark in (2, 3, 4):
        stored = lake.replace("t", stored.unionByName(stored), mark)
    assert Lake(spark, str(tmp_path)).read("t").count() == 3 * 2**3
    assert lake.mark("t") == 4
    assert lake.row_count("t") == 24


def test_a_replacement_without_commit_changes_nothing(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path))
    lake.replace("t", spark.range(3), 1)

    def die(self, commits):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(Lake, "_publish", die)
        with pytest.raises(RuntimeError):
            Lake(spark, str(tmp_path)).replace("t", spark.range(9), 2)
    survivor = Lake(spark, str(tmp_path))
    assert survivor.read("t").count() == 3
    assert survivor.replace("t", spark.range(5), 3).count() == 5


def test_tables_replaced_together_share_one_commit(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.replace_all({"a": spark.range(1), "b": spark.range(2)}, 1)
    again = Lake(spark, str(tmp_path))
    assert (again.row_count("a"), again.row_count("b")) == (1, 2)
    assert set(again.state()) == {"a", "b"}
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|Division"):
        bad = spark.range(1).select((F.lit(1) / F.col("id")).alias("id"))
        lake.replace_all({"a": spark.range(7), "b": bad}, 2)
    assert Lake(spark, str(tmp_path)).read("a").count() == 1


def test_rows_gained_since_a_version(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.replace("t", spark.range(0, 3), 1)
    lake.append("t", spark.range(3, 5), 2)
    lake.append("t", spark.range(0), 3)
    lake.append("t", spark.range(5, 6), 4)
    again = Lake(spark, str(tmp_path))
    ids = {v: [r[0] for r in rows_of(again.read_since("t", v))] for v in (None, 0, 1, 2, 3, 4)}
    assert ids == {
        None: [0, 1, 2, 3, 4, 5],
        0: [0, 1, 2, 3, 4, 5],
        1: [3, 4, 5],
        2: [5],
        3: [5],
        4: [],
    }
    again.replace("t", again.read("t"), 5)
    again.append("t", spark.range(6, 7), 6)
    assert rows_of(Lake(spark, str(tmp_path)).read("t")) == [(i,) for i in range(7)]
    again.replace("t", spark.range(2), 7)
    assert rows_of(Lake(spark, str(tmp_path)).read("t")) == [(0,), (1,)]


def test_only_wanted_versions_are_opened(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.replace("t", spark.range(0, 3), 1)
    lake.append("t", spark.range(3, 5), 2)
    files = lake.read_since("t", 1).select("id").inputFiles()
    text = lake.read_since("t", 1)._jdf.queryExecution().executedPlan().toString()
    assert files and "PartitionFilters" in text and "version" in text


def test_append_without_commit_stays_invisible(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.replace("t", spark.range(3), 1)
    spark.range(50).write.parquet(lake.path("t", lake.state()["t"].version + 1))
    assert Lake(spark, str(tmp_path)).read("t").count() == 3
    assert Lake(spark, str(tmp_path)).append("t", spark.range(1), 2) == 1
    assert Lake(spark, str(tmp_path)).read("t").count() == 4


def test_append_advance_and_marks(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.replace("t", spark.range(3), 1)
    assert lake.append("t", spark.range(2), 5) == 2
    assert lake.append("t", spark.range(0), 6) == 0
    lake.advance("t", 7)
    again = Lake(spark, str(tmp_path))
    assert again.mark("t") == 7
    assert again.changed_to("t") == 2
    assert again.read("t").count() == 5
    with pytest.raises(ValueError, match="beyond"):
        again.advance("t", 6)


def test_the_state_stays_two_small_tables(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.replace("t", spark.range(3), 1)
    for mark in range(2, 8):
        lake.append("t", spark.range(1), mark)
    rows = spark.read.parquet(f"{tmp_path}/state")
    assert rows.count() == 2 and Lake(spark, str(tmp_path)).read("t").count() == 9


def test_a_state_that_was_not_written_to_the_end_leaves_the_one_before(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.replace("t", spark.range(3), 1)
    lake.append("t", spark.range(2), 2)
    io.overwrite(io.typed_empty(spark, spark.range(0).schema), f"{tmp_path}/state/slot=1")
    assert Lake(spark, str(tmp_path)).read("t").count() == 5


def test_layers_take_up_new_columns_and_wider_types(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    lake.replace("t", spark.createDataFrame([(1, 1.5)], "k int, v float"), 1)
    lake.append("t", spark.createDataFrame([(1 << 40, 2.5, "x")], "k long, v double, w string"), 2)
    lake.append("t", spark.createDataFrame([(3, 3.5, None)], "k int, v float, w string"), 3)
    found = Lake(spark, str(tmp_path)).read("t")
    assert found.dtypes == [("k", "bigint"), ("v", "double"), ("w", "string")]
    assert rows_of(found) == [(1, 1.5, None), (1 << 40, 2.5, "x"), (3, 3.5, None)]


def test_appended_columns_take_the_types_and_order_of_the_layer(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    first = spark.createDataFrame([(1, "a")], "k long, v string")
    lake.replace("t", first, 1)
    lake.append("t", spark.createDataFrame([("b", 2)], "v string, k int"), 2)
    assert lake.read("t").dtypes == first.dtypes
    assert rows_of(lake.read("t")) == [(1, "a"), (2, "b")]
    with pytest.raises(AnalysisException):
        lake.append("t", spark.createDataFrame([("b",)], "v string"), 3)


def test_unknown_layer(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Lake(spark, str(tmp_path)).read("t")


BROKEN_CSV = [
    HEADER,
    LINE,
    LINE.rsplit(",", 1)[0],
    f"{LINE},more",
    LINE.replace('"Smith, Sons"', '"Smith'),
    LINE.replace("1,", "x,", 1),
]


def corrupt_csv(spark, path, **options):
    rows = io.set_apart(io.with_lineage(io.read_csv(spark, path, corrupt=CORRUPT_RECORD, **options)))
    io.overwrite(rows, f"{path}_stored", [QUARANTINED])
    return io.read_parquet(spark, f"{path}_stored", rows.schema)


def test_ragged_and_unreadable_csv_records_are_set_apart(spark, tmp_path):
    write_csv(tmp_path / "a.csv", BROKEN_CSV)
    stored = corrupt_csv(spark, str(tmp_path / "a.csv"))
    assert io.sound_rows(stored).count() == 1
    assert io.sound_rows(stored).columns == [*RAW_SCHEMA.names, "source_file"]
    texts = {row.corrupt_record for row in io.quarantined_rows(stored).collect()}
    assert texts == set(BROKEN_CSV[2:])
    assert [row.quarantined for row in io.quarantine_counts(stored).collect()] == [4]


def test_line_breaks_in_quotes(spark, tmp_path):
    whole = LINE.replace("Smith, Sons", "Smith\nSons")
    write_csv(tmp_path / "a.csv", [HEADER, LINE, whole])
    by_line = corrupt_csv(spark, str(tmp_path / "a.csv"))
    assert (io.sound_rows(by_line).count(), io.quarantined_rows(by_line).count()) == (1, 2)
    write_csv(tmp_path / "b.csv", [HEADER, LINE, whole])
    together = corrupt_csv(spark, str(tmp_path / "b.csv"), multi_line=True)
    names = {row.Company for row in io.sound_rows(together).collect()}
    assert names == {"Smith, Sons", "Smith\nSons"}
    assert io.quarantined_rows(together).isEmpty()


def test_inferred_csv_with_corrupt_records(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ["a,b", "1,2", "3"])
    rows = io.read_csv(spark, str(tmp_path / "a.csv"), schema=None, corrupt="bad")
    assert rows_of(rows) == sorted([(1, 2, None), (3, None, "3")], key=repr)


def test_broken_json_lines_are_set_apart(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('{"a": 1}\n{"a": \n{"a": "x"}\n[1]\n')
    for schema in (T.StructType.fromDDL("a long"), None):
        rows = io.read_json(spark, str(path), schema, corrupt="bad").cache()
        assert rows.columns[0] == "a" and "bad" in rows.columns
        assert rows.where("bad IS NULL").count() >= 1 and rows.where("bad IS NOT NULL").count() >= 1
        rows.unpersist()
    typed = io.read_json(spark, str(path), T.StructType.fromDDL("a long"), corrupt="bad")
    assert {row.bad for row in typed.collect()} == {None, '{"a": ', '{"a": "x"}', "[1]"}


def test_tables_without_the_column_are_sound(spark):
    rows = io.set_apart(spark.range(2))
    assert io.sound_rows(rows).count() == 2 and io.quarantined_rows(rows).isEmpty()


def test_sample_rows_leave_nulls_out(spark):
    df = raw_table(spark, [campaign(Company=None)]).select("Campaign_ID", "Company")
    assert io.sample_rows(df, 5, ["Campaign_ID"]).first()[0] == '{"Campaign_ID":1}'


def test_register_view(spark):
    io.register_view(spark.range(4), "four")
    assert spark.sql("SELECT count(*) FROM four").first()[0] == 4


def test_no_file_of_a_layer_has_more_rows_than_a_task_can_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 30)
    lake = Lake(spark, str(tmp_path))
    stored = lake.replace("rows", spark.range(100).coalesce(1), 1)
    per_file = stored.groupBy(F.input_file_name()).count()
    assert sorted(row[1] for row in per_file.collect()) == [10, 30, 30, 30]
