"""Incremental load: take over what is new, layer by layer.

Each layer works out its own backlog from the layer before it: the rows that
one has gained since the version that the layer has come to, less the keys it already
has. A run that died between two layers, or in the middle of a write, is therefore
made good by the next run, whatever batch that one brings.

Only bronze has to look for keys it knows: what is appended to it has new keys, one row
each, so a layer made from it needs neither dedupe nor join for what was appended.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlake import spec as S
from adlake.operators import gold as G
from adlake.operators.clean import business_filter, clean, dedupe_order, first_per_key
from adlake.operators.incremental import (
    BatchKeys,
    distinct_keys,
    measure_keys,
    new_rows,
    rows_of_keys,
    unseen_rows,
)
from adlake.operators.metrics import update_metrics
from adlake.operators.rollup import (
    channel_summary_of,
    daily_summary_of,
    merge_rollups,
    metrics_of,
    rollup,
)
from adlake.sources import lake as L
from adlake.sources.lake import Lake
from adlake.sources.readers import (
    quarantined_rows,
    read_parquet,
    set_apart,
    sound_rows,
    stamp,
    to_micros,
)
from adlake.sources.sinks import overwrite
from adlake.spec import DEFAULT_SPEC, CampaignSpec

COUNTS = "stage string, metric string, value long"


def as_bronze(batch: DataFrame, run_ts: datetime) -> DataFrame:
    """Raw rows with audit columns and the mark of records that could not be read.
    Lineage is taken over where the reader has added it; rows that come from no file
    have none."""
    if S.SOURCE_FILE not in batch.columns:
        batch = batch.withColumn(S.SOURCE_FILE, F.lit(None).cast("string"))
    return set_apart(stamp(batch, S.INGESTED_AT, run_ts))


def require_later(lake: Lake, run_ts: datetime) -> None:
    """Run times have to rise: rows stamped with a time that a layer has passed
    would be taken for old ones."""
    newest = lake.mark(L.BRONZE if lake.has(L.BRONZE) else L.SILVER)
    if newest is not None and to_micros(run_ts) <= newest:
        raise ValueError("run_ts must be later than that of the last run")


def extend_bronze(
    lake: Lake, batch: DataFrame, spec: CampaignSpec, run_ts: datetime
) -> dict[str, int]:
    """Append the unseen keys of a batch; the first batch is stored as it is.

    The batch is read once: it is written below the lake as Parquet, and all that is
    asked of it later reads columns of that. Records that could not be read go to
    quarantine, again those that are not there yet. Returns the numbers of rows
    received, added and quarantined.
    """
    require_later(lake, run_ts)
    now = to_micros(run_ts)
    if lake.has(L.SILVER) and not lake.has(L.BRONZE):
        raise ValueError("this lake is fed by a stream of files")
    rows = as_bronze(batch, run_ts)
    parts = [S.QUARANTINED]
    if not lake.has(L.BRONZE):
        lake.replace(L.BRONZE, rows, now, parts)
        bad = quarantined_rows(lake.read(L.BRONZE)).count()
        count = lake.row_count(L.BRONZE)
        return {"received": count, "added": count - bad, "quarantined": bad}
    staging = f"{lake.root}/staging"
    overwrite(rows, staging, parts, "zstd")
    staged = read_parquet(lake.spark, staging, rows.schema)
    sound, stored = sound_rows(staged), lake.read(L.BRONZE)
    received = measure_keys(sound, spec.keys)
    order = dedupe_order(sound, spec)
    if received.few is not None:
        fresh = new_rows(sound, sound_rows(stored), spec.keys, order, received)
    else:
        fresh = unseen_only(
            lake,
            sound,
            sound_rows(stored),
            list(spec.keys),
            received,
            lambda rows: first_per_key(rows, spec.keys, order),
        )
    bad = staged.where(S.QUARANTINED)
    found = bad.count()
    kept = 0
    if found:
        held = quarantined_rows(stored).select(S.SOURCE_FILE, S.CORRUPT_RECORD).alias("held")
        again = F.col(f"bad.{S.SOURCE_FILE}").eqNullSafe(F.col(f"held.{S.SOURCE_FILE}")) & (
            F.col(f"bad.{S.CORRUPT_RECORD}") == F.col(f"held.{S.CORRUPT_RECORD}")
        )
        bad = bad.alias("bad").join(held, again, "left_anti")
        kept = bad.count()
    more = set_apart(fresh)
    if kept:
        more = more.unionByName(bad)
    added = lake.append(L.BRONZE, more, now, parts)
    return {"received": received.rows + found, "added": added - kept, "quarantined": kept}


def unseen_only(
    lake: Lake,
    rows: DataFrame,
    known: DataFrame,
    keys: list[str],
    batch: BatchKeys,
    step: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``step`` of the rows whose key is not ``known``, for a batch too large for its keys to
    be broadcast.

    The unseen keys are found first, in a shuffle of nothing but keys, and stored; only
    rows that may have one of them go into ``step``, which may shuffle whole rows. A
    batch that was loaded before ends there.
    """
    unseen = unseen_rows(distinct_keys(rows, keys), known, keys, batch)
    path = f"{lake.root}/staging_keys"
    overwrite(unseen, path)
    stored = read_parquet(lake.spark, path, unseen.schema)
    wanted = measure_keys(stored, keys)
    found = step(rows_of_keys(rows, keys, wanted))
    return found if wanted.few is not None else found.join(stored, keys, "left_semi")


def carry(
    lake: Lake,
    layer: str,
    backlog: DataFrame,
    mark: int,
    keys: list[str],
    step: Callable[[DataFrame], DataFrame],
    new_keys: bool,
) -> int:
    """Bring a layer up to ``mark``: run its backlog of source rows through
    ``step`` and store the rows with unseen keys. Returns the number added.

    ``step`` must not make up keys. If all of the backlog's are known to be new to the
    layer (``new_keys``), nothing is looked up.
    """
    if not lake.has(layer):
        lake.replace(layer, step(backlog), mark)
        return lake.row_count(layer)
    if new_keys:
        return lake.append(layer, step(backlog), mark)
    waiting = measure_keys(backlog, keys)
    if waiting.rows == 0:
        lake.advance(layer, mark)
        return 0
    if waiting.few is not None:
        fresh = unseen_rows(step(backlog), lake.read(layer), keys, waiting)
    else:
        fresh = unseen_only(lake, backlog, lake.read(layer), keys, waiting, step)
    return lake.append(layer, fresh, mark)


def refresh_gold(
    lake: Lake,
    spec: CampaignSpec,
    run_ts: datetime,
    mark: int,
    metrics_mode: str = "recompute",
    rebuild: bool = False,
) -> None:
    """Bring the reporting tables in line with the filtered layer.

    Only rows that are new since the last time are looked at. The channel, daily
    and metrics tables come from the stored rollup, to which the new rows are
    added. Where the campaign table's groups include the unique key, those of new
    rows never touch existing ones: each is a row by itself and is appended. Under
    other keys a new row may belong to a stored group, and the table is made anew.
    The result is what all filtered rows together would give. ``rebuild`` does
    start from all of them.
    """
    alone = G.one_row_per_group(spec)
    filtered = lake.read(L.FILTERED)
    if rebuild or not lake.has(L.ROLLUP):
        rolled = rollup(filtered, spec)
    else:
        new = lake.read_since(L.FILTERED, lake.mark(L.ROLLUP))
        rolled = merge_rollups(lake.read(L.ROLLUP), rollup(new, spec), spec)
    rolled = lake.replace(L.ROLLUP, rolled, mark)
    metrics = metrics_of(rolled, run_ts)
    if lake.has(L.SQL_METRICS):
        metrics = update_metrics(lake.read(L.SQL_METRICS), metrics, metrics_mode)
    tables = {
        L.CHANNEL_SUMMARY: channel_summary_of(rolled, spec, run_ts),
        L.DAILY_SUMMARY: daily_summary_of(rolled, spec, run_ts),
        L.SQL_METRICS: metrics,
    }
    if rebuild or not alone or not lake.has(L.CAMPAIGN_SUMMARY):
        tables[L.CAMPAIGN_SUMMARY] = G.campaign_summary(filtered, spec, run_ts, alone)
    elif _behind(lake, L.CAMPAIGN_SUMMARY, mark):
        new = lake.read_since(L.FILTERED, lake.mark(L.CAMPAIGN_SUMMARY))
        summary = G.campaign_summary(new, spec, run_ts, alone)
        lake.append(L.CAMPAIGN_SUMMARY, summary, mark)
    lake.replace_all(tables, mark)


def _behind(lake: Lake, layer: str, mark: int) -> bool:
    reached = lake.mark(layer)
    return reached is None or reached < mark


def propagate(
    lake: Lake,
    bronze_since: Callable[[int | None], DataFrame],
    mark: int,
    spec: CampaignSpec,
    run_ts: datetime,
    metrics_mode: str = "recompute",
) -> dict[str, int]:
    """Carry bronze rows up to ``mark`` on to silver, filtered and gold.

    ``bronze_since`` gives the sound bronze rows beyond a mark (None: all).
    A layer whose source has not changed since is left alone, so a run without
    new rows ends here. Returns the rows added per layer.
    """
    keys = list(spec.keys)
    added = {L.SILVER: 0, L.FILTERED: 0}
    if _behind(lake, L.SILVER, mark):
        unique = lake.made_from_current(L.SILVER, L.BRONZE)
        added[L.SILVER] = carry(
            lake,
            L.SILVER,
            bronze_since(lake.mark(L.SILVER)),
            mark,
            keys,
            lambda rows: clean(rows, spec, run_ts, unique),
            unique,
        )
    changed = lake.changed_to(L.SILVER)
    if _behind(lake, L.FILTERED, changed):
        added[L.FILTERED] = carry(
            lake,
            L.FILTERED,
            lake.read_since(L.SILVER, lake.mark(L.FILTERED)),
            changed,
            keys,
            lambda rows: business_filter(rows, spec, run_ts),
            lake.made_from_current(L.FILTERED, L.SILVER),
        )
    changed = lake.changed_to(L.FILTERED)
    tables = (
        L.CAMPAIGN_SUMMARY,
        L.CHANNEL_SUMMARY,
        L.DAILY_SUMMARY,
        L.SQL_METRICS,
    )
    if any(_behind(lake, table, changed) for table in tables):
        refresh_gold(lake, spec, run_ts, changed, metrics_mode)
    return added


def run_increment(
    spark: SparkSession,
    batch: DataFrame,
    root: str,
    spec: CampaignSpec = DEFAULT_SPEC,
    run_ts: datetime | None = None,
    metrics_mode: str = "recompute",
) -> DataFrame:
    """Load one batch of raw rows into the lake at ``root``.

    Loading a batch again adds nothing. Returns the row accounting as a table
    (stage, metric, value).
    """
    run_ts = run_ts or datetime.now(UTC)
    lake = Lake(spark, root)
    bronze = extend_bronze(lake, batch, spec, run_ts)

    def bronze_since(version: int | None) -> DataFrame:
        return sound_rows(lake.read_since(L.BRONZE, version))

    mark = lake.changed_to(L.BRONZE)
    added = propagate(lake, bronze_since, mark, spec, run_ts, metrics_mode)
    return spark.createDataFrame(
        [
            ("bronze", "rows_received", bronze["received"]),
            ("bronze", "rows_added", bronze["added"]),
            ("bronze", "rows_quarantined", bronze["quarantined"]),
            ("silver", "rows_added", added[L.SILVER]),
            ("filtered", "rows_added", added[L.FILTERED]),
        ],
        COUNTS,
    )
