"""Reading and writing tables."""

from adlake.sources.lake import Lake
from adlake.sources.readers import (
    has_rows,
    quarantine_counts,
    quarantined_rows,
    read_any,
    read_csv,
    read_json,
    read_or_empty,
    read_parquet,
    read_report,
    register_view,
    row_count,
    sample_rows,
    schema_listing,
    set_apart,
    sound_rows,
    stamp,
    unreadable_cells,
    with_lineage,
)
from adlake.sources.sinks import append_rows, overwrite, shared_dir, typed_empty

__all__ = [
    "Lake",
    "append_rows",
    "has_rows",
    "overwrite",
    "quarantine_counts",
    "quarantined_rows",
    "read_any",
    "read_csv",
    "read_json",
    "read_or_empty",
    "read_parquet",
    "read_report",
    "register_view",
    "row_count",
    "sample_rows",
    "schema_listing",
    "set_apart",
    "shared_dir",
    "sound_rows",
    "stamp",
    "typed_empty",
    "unreadable_cells",
    "with_lineage",
]
