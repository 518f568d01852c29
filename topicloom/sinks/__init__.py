"""Batch writers."""

from topicloom.sinks.buckets import read_buckets, upsert_buckets
from topicloom.sinks.writers import (
    load_graph, save_graph, upsert_parquet, write_by_year, write_classified, write_csv, write_embeddings,
    write_hierarchy,
)

__all__ = [
    "load_graph", "read_buckets", "save_graph", "upsert_buckets", "upsert_parquet", "write_by_year", "write_classified",
    "write_csv", "write_embeddings", "write_hierarchy",
]
