"""Layer tables that can be rebuilt from themselves and appended to.

A layer is one Parquet table, partitioned by the version that wrote its rows, and the
state of the lake is one row per layer that says which versions count:

    <root>/<layer>/version=<n>   rows of one write
    <root>/state/slot=<0 or 1>   the last two states, of which the newer one holds

Every write goes to a version of its own that counts once the state names it. So a plan
may read the layer it is about to replace, and a job that dies half way leaves the old
rows in force; the next write takes the same version and overwrites what it left.

A layer that is made from another one notes the version of its source it has come to, its
mark. What a source has gained since is then a filter on its partitions.

One run at a time may write to a lake; nothing keeps a second one out.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlake.sources.readers import read_or_empty, read_parquet
from adlake.sources.sinks import overwrite

BRONZE = "bronze"
SILVER = "silver"
FILTERED = "filtered"
CAMPAIGN_SUMMARY = "campaign_summary"
CHANNEL_SUMMARY = "channel_summary"
DAILY_SUMMARY = "daily_summary"
SQL_METRICS = "sql_metrics"
ROLLUP = "rollup"
PROFILE_GROUPS = "profile_groups"
STREAMED = "bronze_stream"

VERSION = "version"


class LayerState(NamedTuple):
    """A layer after a write: its versions from ``base``, the last replacement, to
    ``version`` count. ``mark`` is what its source had come to, ``base_mark`` what it had
    come to at the last replacement, and ``changed_to`` the last version that brought rows."""

    layer: str
    base: int
    version: int
    base_mark: int
    mark: int
    changed_to: int
    row_count: int
    schema_json: str


STATE_SCHEMA = T.StructType(
    [
        T.StructField("commit", T.LongType()),
        T.StructField("layer", T.StringType()),
        T.StructField("base", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("base_mark", T.LongType()),
        T.StructField("mark", T.LongType()),
        T.StructField("changed_to", T.LongType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("schema_json", T.StringType()),
    ]
)


def _schema(state: LayerState) -> T.StructType:
    return T.StructType.fromJson(json.loads(state.schema_json))


#: Types that hold all values of others.
WIDER = {
    T.ByteType(): (T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType()),
    T.ShortType(): (T.IntegerType(), T.LongType(), T.DoubleType()),
    T.IntegerType(): (T.LongType(), T.DoubleType()),
    T.FloatType(): (T.DoubleType(),),
}


def wider_type(known: T.DataType, other: T.DataType | None) -> T.DataType:
    """``other`` if it holds all values of ``known``, else ``known``."""
    return other if other in WIDER.get(known, ()) else known


def _require_rising(before: LayerState | None, mark: int) -> None:
    """Source rows up to a mark that the layer has passed would be taken over again."""
    if before is not None and mark < before.mark:
        raise ValueError(f"{before.layer} has come to {before.mark}, beyond {mark}")


class Lake:
    """The layers below one folder.

    The object knows the state at its first use and its own writes; take a new one to
    see what another run has written since.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._commit = 0
        self._state: dict[str, LayerState] | None = None

    def state(self) -> dict[str, LayerState]:
        """The state of each layer."""
        if self._state is None:
            slots = read_or_empty(self.spark, f"{self.root}/state", STATE_SCHEMA)
            rows = slots.select(*STATE_SCHEMA.names).collect()
            self._commit = max((row["commit"] for row in rows), default=0)
            newest = (row for row in rows if row["commit"] == self._commit)
            self._state = {row["layer"]: LayerState(*row[1:]) for row in newest}
        return self._state

    def has(self, layer: str) -> bool:
        return layer in self.state()

    def mark(self, layer: str) -> int | None:
        return self.state()[layer].mark if self.has(layer) else None

    def changed_to(self, layer: str) -> int:
        """The last version of a layer that brought rows; 0 for a layer not there yet."""
        return self.state()[layer].changed_to if self.has(layer) else 0

    def row_count(self, layer: str) -> int:
        return self.state()[layer].row_count if self.has(layer) else 0

    def made_from_current(self, layer: str, source: str) -> bool:
        """Whether all rows of a layer come from what its source holds: from no table
        that has been replaced since."""
        state = self.state()
        return {layer, source} <= state.keys() and state[source].base <= state[layer].base_mark

    def read(self, layer: str) -> DataFrame:
        return self.read_since(layer, None)

    def read_since(self, layer: str, version: int | None) -> DataFrame:
        """The rows a layer has gained by writes beyond ``version``."""
        if not self.has(layer):
            raise FileNotFoundError(f"no {layer} committed at {self.root}")
        state = self.state()[layer]
        first = state.base if version is None else max(state.base, version + 1)
        schema = T.StructType([*_schema(state).fields, T.StructField(VERSION, T.LongType())])
        table = read_parquet(self.spark, f"{self.root}/{layer}", schema)
        return table.where(F.col(VERSION).between(first, state.version)).drop(VERSION)

    def replace(
        self, layer: str, df: DataFrame, mark: int, partition_by: Sequence[str] = ()
    ) -> DataFrame:
        """Write ``df`` as the new content of a layer; returns what was stored."""
        self._publish([self._write(layer, df, mark, True, partition_by)])
        return self.read(layer)

    def replace_all(self, tables: Mapping[str, DataFrame], mark: int) -> None:
        """Replace several layers, side by side, under one state: readers see all of the
        new tables or none."""
        self.state()
        with ThreadPoolExecutor(len(tables)) as pool:
            jobs = [pool.submit(self._write, *table, mark, True) for table in tables.items()]
            self._publish([job.result() for job in jobs])

    def append(
        self, layer: str, df: DataFrame, mark: int, partition_by: Sequence[str] = ()
    ) -> int:
        """Add rows to an existing layer. Returns how many it has more now.

        Columns are matched by name and cast to the layer's types; where those of ``df``
        are wider, the layer's become so. A column that the layer does not have joins it,
        and is null in earlier rows; one that ``df`` does not have is an error.
        """
        before = self.row_count(layer)
        known = _schema(self.state()[layer])
        kinds = dict(zip(df.schema.names, (field.dataType for field in df.schema)))
        columns = [
            F.col(f.name).cast(wider_type(f.dataType, kinds.get(f.name))).alias(f.name) for f in known
        ]
        more = [F.col(name) for name in df.columns if name not in known.names]
        self._publish([self._write(layer, df.select(*columns, *more), mark, False, partition_by)])
        return self.row_count(layer) - before

    def advance(self, layer: str, mark: int) -> None:
        """Note that the source had nothing for the layer up to ``mark``."""
        before = self.state()[layer]
        _require_rising(before, mark)
        self._publish([before._replace(mark=mark)])

    def path(self, layer: str, version: int) -> str:
        return f"{self.root}/{layer}/{VERSION}={version}"

    def _write(
        self, layer: str, df: DataFrame, mark: int, whole: bool, partition_by: Sequence[str] = ()
    ) -> LayerState:
        before = self.state().get(layer)
        _require_rising(before, mark)
        version = before.version + 1 if before else 1
        path = self.path(layer, version)
        overwrite(df, path, partition_by)
        count = read_parquet(self.spark, path, df.schema).count()
        if whole or before is None:
            return LayerState(layer, version, version, mark, mark, version, count, df.schema.json())
        return before._replace(
            version=version,
            mark=mark,
            changed_to=version if count else before.changed_to,
            row_count=before.row_count + count,
            schema_json=df.schema.json(),
        )

    def _publish(self, written: Sequence[LayerState]) -> None:
        """Let the written versions count, in place of the state before the last one."""
        state = self.state() | {layer.layer: layer for layer in written}
        commit = self._commit + 1
        rows = [(commit, *layer) for layer in state.values()]
        listing = self.spark.createDataFrame(rows, STATE_SCHEMA).coalesce(1)
        overwrite(listing, f"{self.root}/state/slot={commit % 2}")
        self._commit, self._state = commit, state
