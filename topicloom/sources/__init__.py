"""Batch readers for the raw and the intermediate layers."""

from topicloom.sources.readers import (
    read_csv, read_csv_in_splits, read_csv_tree, read_embeddings, read_hierarchy, read_triples, read_xml_rows, split_bad_rows,
)

__all__ = [
    "read_csv", "read_csv_in_splits", "read_csv_tree", "read_embeddings", "read_hierarchy", "read_triples", "read_xml_rows",
    "split_bad_rows",
]
