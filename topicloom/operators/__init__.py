"""Operators on DataFrames: joins, aggregates, top-k, upsert, classification, linking."""
