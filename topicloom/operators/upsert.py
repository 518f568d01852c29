"""Upserts of node and edge sets. Running the same upsert twice changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_rows(existing: DataFrame | None, new: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    """One row per key: a whole new row, whose nulls are filled from the old row.

    Old and new rows meet in one aggregation, which also folds repeated keys. Among new rows
    of one key the one with the greatest ``order`` is taken, or without it, and among equals,
    the greatest by its properties in the order of the columns; never a mixture of several.
    """
    rows = new.withColumn("_age", F.lit(1))
    if existing is not None:
        rows = existing.withColumn("_age", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    props = [c for c in rows.columns if c not in (*keys, "_age", order)]
    if not props:
        return rows.select(*keys).distinct()
    row = F.struct(*([order] if order else []), *props)
    picked = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("_age") == 1, row)).alias("_new"), F.max(F.when(F.col("_age") == 0, row)).alias("_old")
    )
    return picked.select(*keys, *[F.coalesce(F.col("_new")[c], F.col("_old")[c]).alias(c) for c in props])


def upsert_nodes(existing: DataFrame | None, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Nodes after merging ``new`` into ``existing`` by ``key``."""
    return merge_rows(existing, new.where(F.col(key).isNotNull()), [key], order)


def upsert_edges(
    existing: DataFrame | None,
    new: DataFrame,
    src_nodes: DataFrame,
    dst_nodes: DataFrame,
    props: Sequence[str] = (),
    order: str | None = None,
) -> DataFrame:
    """Edges after merging ``new`` by (src, dst).

    ``src_nodes`` and ``dst_nodes`` are one-column frames of keys; an edge with an end outside
    of them is left out.
    """
    src, dst = src_nodes.columns[0], dst_nodes.columns[0]
    kept = new.select("src", "dst", *props, *([order] if order else []))
    kept = kept.join(src_nodes.select(F.col(src).alias("src")), "src", "left_semi")
    kept = kept.join(dst_nodes.select(F.col(dst).alias("dst")), "dst", "left_semi")
    return merge_rows(existing, kept.select("src", "dst", *props, *([order] if order else [])), ["src", "dst"], order)


def hierarchy_to_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics and SUBTOPIC_OF edges (child to parent) of a hierarchy ``parent, child``."""
    topics = edges.select(F.explode(F.array("parent", "child")).alias("name")).distinct()
    subtopic_of = edges.select(F.col("child").alias("src"), F.col("parent").alias("dst")).distinct()
    return topics, subtopic_of
