from tidemark.sources.readers import (
    explode_responses,
    load_split,
    map_batches,
    read_json_array,
    read_ndjson,
    read_table,
    unpack_tables,
)
from tidemark.sources.store import StoreResult, materialize_missing
from tidemark.sources.writers import write_csv, write_leaderboard, write_ndjson, write_table

__all__ = [
    "StoreResult", "explode_responses", "load_split", "map_batches", "materialize_missing",
    "read_json_array", "read_ndjson", "read_table", "unpack_tables", "write_csv",
    "write_leaderboard", "write_ndjson", "write_table",
]
