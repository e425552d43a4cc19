from cohortlens.sources.files import (
    RAW_COMMENT_SCHEMA,
    RAW_SUBMISSION_SCHEMA,
    read_csv,
    read_json,
    read_shards,
    write_shards,
)
from cohortlens.sources.sinks import fetch_columns, fetch_pages, materialize, save, scratch_path, scratch_root, scratch_run

__all__ = [
    "RAW_COMMENT_SCHEMA",
    "RAW_SUBMISSION_SCHEMA",
    "fetch_columns",
    "fetch_pages",
    "materialize",
    "read_csv",
    "read_json",
    "read_shards",
    "save",
    "scratch_path",
    "scratch_root",
    "scratch_run",
    "write_shards",
]
