"""Aggregates. Counts and sums combine on the map side, so a hot key costs no more than others."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def edge_count_by(edges: DataFrame, key: str, counted: str = "src", name: str = "n") -> DataFrame:
    """Edges per key; a null end is not counted."""
    return edges.groupBy(key).agg(F.count(counted).alias(name))


def count_by(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def sum_by(df: DataFrame, key: str, col: str, name: str = "total") -> DataFrame:
    return df.groupBy(key).agg(F.sum(col).alias(name))


def collect_series(df: DataFrame, key: str, order: str, val: str, name: str = "series") -> DataFrame:
    """Per key one array of ``{order, val}`` structs in order.

    Expects counted rows, at most one per key and step (a few years), never raw events.
    """
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, val))).alias(name))


def joined_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` on rows that stand in order of their first column: one row per run of equal keys, null being a
    key, too, with the other columns, which are strings, joined; null strings are left out."""
    held: list[pa.Table] = []  # of the last key, whose run may go on in the next batch

    def joined(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if tables:
            table = pa.concat_tables(tables).combine_chunks()
            runs = pc.run_end_encode(table[0].combine_chunks())
            starts = pa.array(np.concatenate([[0], runs.run_ends.to_numpy()]), pa.int32())
            texts = [pc.binary_join(pa.ListArray.from_arrays(starts, pc.fill_null(c, "").combine_chunks()), "") for c in table.columns[1:]]
            yield from pa.table([runs.values, *texts], names=table.column_names).to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        ends = pc.run_end_encode(table[0].combine_chunks()).run_ends.to_pylist()[-2:]
        if held and held[0][0][0] != table[0][0]:
            yield from joined(held)
            held = []
        if len(ends) > 1:
            yield from joined([*held, table.slice(0, ends[0])])
            held = []
            table = table.slice(ends[0])
        held.append(table)
    yield from joined(held)


def distinct_count_by(df: DataFrame, key: str, col: str, name: str = "n") -> DataFrame:
    """Spark shuffles by (key, value) first, so a hot key is spread over its values."""
    return df.groupBy(key).agg(F.count_distinct(col).alias(name))


def distinct_by(df: DataFrame, key: str, col: str) -> DataFrame:
    """Per key each distinct value that is not null, one per row: the form for keys of any size."""
    return df.select(key, col).where(F.col(col).isNotNull()).distinct()


def collect_distinct_by(df: DataFrame, key: str, col: str, name: str = "values") -> DataFrame:
    """Per key one row with the sorted array of its distinct values.

    The array of a key is one value, so it must fit a task; ``distinct_by`` has no such bound.
    """
    return distinct_by(df, key, col).groupBy(key).agg(F.sort_array(F.collect_list(col)).alias(name))


def children_by_parent(edges: DataFrame) -> DataFrame:
    """Distinct children per parent as ``parent, children``, one row per parent."""
    return collect_distinct_by(edges, "parent", "child", name="children")


def sum_if(cond: Column, col: Column | str) -> Column:
    """Sum where the condition holds, 0 if it never does."""
    return F.coalesce(F.sum(F.when(cond, F.col(col) if isinstance(col, str) else col)), F.lit(0))


def growth(df: DataFrame, key: str, step: str, val: str, start: int, end: int) -> DataFrame:
    """Per key the values at the first and the last step, and their difference."""
    ends = df.groupBy(key).agg(
        sum_if(F.col(step) == start, val).alias("count_start"), sum_if(F.col(step) == end, val).alias("count_end")
    )
    return ends.withColumn("growth", F.col("count_end") - F.col("count_start"))


def exists_by(df: DataFrame, keys: DataFrame, key: str, name: str = "present") -> DataFrame:
    """Each key with whether it occurs in ``df``."""
    marks = df.groupBy(key).agg(F.lit(True).alias(name))
    return keys.select(key).join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` of each key, found by a map-side combining maximum."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(key, "row.*")
