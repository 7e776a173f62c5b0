"""Profiling, validation and reconciliation.

Counts that need no grouping are gathered in one aggregate over the table and
turned into rows afterwards, however many columns are checked.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlake.functions import (
    any_negative,
    ctr_when_served,
    is_negative,
    outside_unit_range,
)
from adlake.operators.clean import in_business, typed_cost
from adlake.sources.readers import sample_rows, schema_listing
from adlake.spec import DEFAULT_SPEC, CampaignSpec


def _long(
    wide: DataFrame, cells: Sequence[tuple[Sequence[Column], str]], names: Sequence[str]
) -> DataFrame:
    """One row of many values → one row per value, with its labels."""
    rows = F.array(
        *(
            F.struct(*(c.alias(n) for c, n in zip((*labels, F.col(value)), names)))
            for labels, value in cells
        )
    )
    return wide.select(F.inline(rows))


def counts_per_column(
    df: DataFrame, conditions: Mapping[str, Column], count_name: str
) -> DataFrame:
    """How many rows meet each column's condition: (column, count)."""
    wide = df.agg(
        *(F.count_if(test).alias(f"c{i}") for i, test in enumerate(conditions.values()))
    )
    cells = [((F.lit(name),), f"c{i}") for i, name in enumerate(conditions)]
    return _long(wide, cells, ["column", count_name])


def _is_null(columns: Sequence[str]) -> dict[str, Column]:
    return {name: F.col(name).isNull() for name in columns}


def _numbers(
    df: DataFrame, columns: Sequence[str], spec: CampaignSpec
) -> dict[str, Column]:
    """The columns as numbers; currency text is read as an amount first."""
    return {
        name: typed_cost(df, spec) if name == spec.currency else F.col(name)
        for name in columns
    }


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return counts_per_column(df, _is_null(columns or df.columns), "nulls")


def critical_nulls(df: DataFrame, spec: CampaignSpec = DEFAULT_SPEC) -> DataFrame:
    return null_counts(df, spec.critical)


def null_audit(
    df: DataFrame, columns: Sequence[str], parsed: Mapping[str, Column]
) -> DataFrame:
    """Nulls per column before and after replacing some columns by a parsed form."""
    wide = df.agg(
        *(F.count_if(F.col(name).isNull()).alias(f"before_{name}") for name in columns),
        *(
            F.count_if(parsed.get(name, F.col(name)).isNull()).alias(f"after_{name}")
            for name in columns
        ),
    )
    cells = [
        ((F.lit(name), F.col(f"before_{name}")), f"after_{name}") for name in columns
    ]
    return _long(wide, cells, ["column", "nulls_before", "nulls_after"])


def negative_counts(
    df: DataFrame, columns: Sequence[str], spec: CampaignSpec = DEFAULT_SPEC
) -> DataFrame:
    numbers = _numbers(df, columns, spec)
    return counts_per_column(
        df, {name: is_negative(value) for name, value in numbers.items()}, "negatives"
    )


def rows_any_negative(
    df: DataFrame, columns: Sequence[str], spec: CampaignSpec = DEFAULT_SPEC
) -> DataFrame:
    """Rows with a negative number in one of the columns."""
    return df.where(any_negative(_numbers(df, columns, spec).values()))


def range_conditions() -> dict[str, Column]:
    served_ctr = ctr_when_served(F.col("Clicks"), F.col("Impressions"))
    return {
        "CTR": outside_unit_range(served_ctr),
        "Conversion_Rate": outside_unit_range(F.col("Conversion_Rate")),
    }


def range_violations(df: DataFrame) -> DataFrame:
    """Rows whose click-through or conversion rate is not within [0, 1]."""
    return counts_per_column(df, range_conditions(), "violations")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count; null is a key."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.where(F.col("row_count") > 1)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, value) pairs of text columns from one scan."""
    return df.unpivot([], list(columns), "column", "value").distinct()


def distinct_counts(
    df: DataFrame, columns: Sequence[str], approximate: bool = False
) -> DataFrame:
    """Number of distinct values per column, null counting as a value.

    ``approximate`` replaces the exact shuffle of all values by one sketch per
    column, for columns that are nearly unique.
    """
    if approximate:
        wide = df.agg(
            *(
                (
                    F.approx_count_distinct(name)
                    + F.max(F.col(name).isNull().cast("long"))
                ).alias(name)
                for name in columns
            )
        )
        cells = [((F.lit(name),), name) for name in columns]
        return _long(wide, cells, ["column", "distinct_values"])
    values = distinct_values(df, columns)
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


def row_delta(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """Row counts of both sides and how many rows the raw side has more."""
    sides = [
        side.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("rows").alias("what"), F.lit(name).alias("side"), "n"
        )
        for name, side in (("raw", raw), ("stored", stored))
    ]
    both = sides[0].unionByName(sides[1]).groupBy("what").agg(
        F.max(F.when(F.col("side") == "raw", F.col("n"))).alias("raw_rows"),
        F.max(F.when(F.col("side") == "stored", F.col("n"))).alias("stored_rows"),
    )
    return both.select(
        "raw_rows",
        "stored_rows",
        (F.col("raw_rows") - F.col("stored_rows")).alias("new_rows"),
    )


def stage_row_counts(
    raw: DataFrame, silver: DataFrame, spec: CampaignSpec = DEFAULT_SPEC
) -> DataFrame:
    """Rows in and rows kept per stage: (stage, metric, value).

    Counted from the tables. Counters that ride along with a running job may
    count a task twice when an executor is lost.
    """
    has_key = reduce(and_, (F.col(name).isNotNull() for name in spec.keys))
    raw_side = raw.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(has_key).alias("keyed")
    )
    silver_side = silver.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(in_business(spec)).alias("kept")
    )
    names = ["stage", "metric", "value"]
    bronze = _long(
        raw_side,
        [
            ((F.lit("bronze"), F.lit("rows")), "rows"),
            ((F.lit("bronze"), F.lit("rows_with_key")), "keyed"),
        ],
        names,
    )
    later = _long(
        silver_side,
        [
            ((F.lit("silver"), F.lit("rows")), "rows"),
            ((F.lit("filtered"), F.lit("rows")), "kept"),
        ],
        names,
    )
    return bronze.unionByName(later)


def profile_counts(
    df: DataFrame, numeric: Sequence[str], spec: CampaignSpec = DEFAULT_SPEC
) -> DataFrame:
    """Rows, nulls, negatives and rows with any negative from one aggregate:
    (check, column, value)."""
    numbers = _numbers(df, numeric, spec)
    tests: dict[tuple[str, str], Column] = {("rows", "*"): F.lit(True)}
    tests |= {("nulls", name): test for name, test in _is_null(df.columns).items()}
    tests |= {
        ("negatives", name): is_negative(value) for name, value in numbers.items()
    }
    tests["any_negative", "*"] = any_negative(numbers.values())
    wide = df.agg(
        *(F.count_if(test).alias(f"c{i}") for i, test in enumerate(tests.values()))
    )
    cells = [
        ((F.lit(check), F.lit(column)), f"c{i}")
        for i, (check, column) in enumerate(tests)
    ]
    return _long(wide, cells, ["check", "column", "value"])


def profile_groups(df: DataFrame, keys: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and all values of every dimension, from one
    aggregate over grouping sets: the keys, ``column`` (the dimension, null for keys),
    ``value`` and ``row_count``. Null is a key and a value."""
    sets = [[F.col(name) for name in keys], *([F.col(name)] for name in dimensions)]
    columns = [F.col(name) for name in (*keys, *dimensions)]
    labels = F.coalesce(*(F.when(F.grouping(name) == 0, F.lit(name)) for name in dimensions))
    counted = df.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("row_count"), labels.alias("column"))
    return counted.where(F.col("column").isNotNull() | (F.col("row_count") > 1)).select(
        *keys, "column", F.coalesce(*dimensions).alias("value"), "row_count"
    )


def profile(
    df: DataFrame,
    spec: CampaignSpec = DEFAULT_SPEC,
    sample: int = 5,
    stored: Callable[[DataFrame], DataFrame] = lambda groups: groups,
) -> dict[str, DataFrame]:
    """Everything known about a bronze table, from two passes over it: one aggregate for
    all counts, and one for the groups of keys and dimensions, which ``stored`` may write
    somewhere so that the tables made of it don't start from ``df`` again. Samples read
    only what they show; duplicates and distinct values stay tables, however many there
    are."""
    numeric = [*spec.keys, *spec.measures]
    counts = profile_counts(df, numeric, spec)
    groups = stored(profile_groups(df, spec.keys, spec.profiled_dimensions))
    values = groups.where(F.col("column").isNotNull())
    return {
        "schema": schema_listing(df),
        "sample": sample_rows(df, sample),
        "counts": counts,
        "duplicates": groups.where(F.col("column").isNull()).select(*spec.keys, "row_count"),
        "invalid_sample": sample_rows(rows_any_negative(df, numeric, spec), sample),
        "distinct_values": values.select("column", "value"),
        "distinct_counts": values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values")),
    }


RECONCILED = ("Clicks", "Impressions")
GOLD_TOTALS = "table string, scope string, metric string, gold long"


def _scoped_total(column: str, scope: str, spec: CampaignSpec) -> Column:
    """Sum over all rows, or over those with a date."""
    value = F.col(column)
    if scope == "dated":
        value = F.when(F.col(spec.date).isNotNull(), value)
    return F.sum(value)


def _all_gold_totals(
    gold: Mapping[str, DataFrame], compared: Sequence[tuple[str, str]]
) -> DataFrame:
    """Totals of several summaries, each labelled with the rows it stands for."""
    if not compared:
        raise ValueError("no summary to reconcile")
    parts = [
        _gold_totals(gold[table], "gold").select(
            F.lit(table).alias("table"), F.lit(scope).alias("scope"), "metric", "gold"
        )
        for table, scope in compared
    ]
    return reduce(DataFrame.unionByName, parts)


def _source_totals(filtered: DataFrame, name: str) -> DataFrame:
    wide = filtered.agg(*(F.sum(column).alias(column) for column in RECONCILED))
    return _long(
        wide, [((F.lit(column),), column) for column in RECONCILED], ["metric", name]
    )


def _gold_totals(summary: DataFrame, name: str) -> DataFrame:
    wide = summary.agg(
        *(F.sum(f"Total_{column}").alias(column) for column in RECONCILED)
    )
    return _long(
        wide, [((F.lit(column),), column) for column in RECONCILED], ["metric", name]
    )


def reconcile(filtered: DataFrame, summary: DataFrame) -> DataFrame:
    """Totals of the filtered rows against those of a summary built from them:
    (metric, silver, gold, matches)."""
    silver = _source_totals(filtered, "silver")
    return silver.join(_gold_totals(summary, "gold"), "metric").withColumn(
        "matches", F.col("silver").eqNullSafe(F.col("gold"))
    )


def reconcile_gold(
    filtered: DataFrame,
    gold: Mapping[str, DataFrame],
    spec: CampaignSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Each summary against the rows it is built from.

    The daily table covers dated rows only, so it is held against those; its
    comparison with all rows is listed as well, and differs when dates are
    missing. Both row sets are totalled in one scan.
    """
    scopes = ("all", "dated")
    wide = filtered.agg(
        *(
            _scoped_total(column, scope, spec).alias(f"{scope}_{column}")
            for scope in scopes
            for column in RECONCILED
        )
    )
    silver = _long(
        wide,
        [
            ((F.lit(scope), F.lit(column)), f"{scope}_{column}")
            for scope in scopes
            for column in RECONCILED
        ],
        ["scope", "metric", "silver"],
    )
    compared = (
        ("campaign_summary", "all"),
        ("channel_summary", "all"),
        ("daily_summary", "all"),
        ("daily_summary", "dated"),
    )
    totals = _all_gold_totals(gold, [pair for pair in compared if pair[0] in gold])
    return (
        totals.join(silver, ["scope", "metric"])
        .withColumn("matches", F.col("silver").eqNullSafe(F.col("gold")))
        .select("table", "scope", "metric", "silver", "gold", "matches")
    )


def validate(
    filtered: DataFrame,
    gold: Mapping[str, DataFrame],
    spec: CampaignSpec = DEFAULT_SPEC,
) -> DataFrame:
    """All checks as one table: (check, column, violations, passed).

    Reconciliation counts as violated when a summary's total differs from that
    of the rows it is built from. Summaries that are not given are not checked.
    """
    numbers = _numbers(filtered, spec.measures, spec)
    tests: dict[tuple[str, str], Column] = {
        ("critical_nulls", name): test for name, test in _is_null(spec.critical).items()
    }
    tests |= {
        ("negative_values", name): is_negative(value) for name, value in numbers.items()
    }
    tests |= {("unit_range", name): test for name, test in range_conditions().items()}
    measured = {label: F.count_if(test) for label, test in tests.items()}
    for scope in ("all", "dated"):
        for column in RECONCILED:
            measured[scope, column] = _scoped_total(column, scope, spec)
    wide = filtered.agg(
        *(value.alias(f"c{i}") for i, value in enumerate(measured.values()))
    )
    silver = _long(
        wide,
        [
            ((F.lit(check), F.lit(column)), f"c{i}")
            for i, (check, column) in enumerate(measured)
        ],
        ["scope", "metric", "silver"],
    )
    own_scope = {
        "campaign_summary": "all",
        "channel_summary": "all",
        "daily_summary": "dated",
    }
    compared = [(table, own_scope[table]) for table in own_scope if table in gold]
    if compared:
        totals = _all_gold_totals(gold, compared)
    else:
        totals = filtered.sparkSession.createDataFrame([], GOLD_TOTALS)
    found = silver.join(totals, ["scope", "metric"], "left")
    is_total = F.col("scope").isin("all", "dated")
    differs = (~F.col("silver").eqNullSafe(F.col("gold"))).cast("long")
    return (
        found.where(~is_total | F.col("table").isNotNull())
        .select(
            F.when(is_total, F.concat(F.lit("totals_"), "table"))
            .otherwise(F.col("scope"))
            .alias("check"),
            F.col("metric").alias("column"),
            F.when(is_total, differs).otherwise(F.col("silver")).alias("violations"),
        )
        .withColumn("passed", F.col("violations") == 0)
    )
