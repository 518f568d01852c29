"""Ranking. Spark limits each group on the map side before the shuffle (``WindowGroupLimit``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(x: str | Column | Sequence[str | Column]) -> list[str | Column]:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def top_k_per_key(df: DataFrame, key, order, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key; ``order`` should end in a unique column."""
    w = Window.partitionBy(*_cols(key)).orderBy(*_cols(order))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def top_k_array(df: DataFrame, key: str, order, k: int, fields: Sequence[str], name: str = "top") -> DataFrame:
    """First ``k`` rows of each key as an array of structs in rank order."""
    ranked = top_k_per_key(df, key, order, k, rank="_rank")
    items = F.sort_array(F.collect_list(F.struct("_rank", *fields)))
    return ranked.groupBy(key).agg(
        F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name)
    )


def top_n(df: DataFrame, order, n: int | None) -> DataFrame:
    """Sorted rows, only the first ``n`` if given."""
    ordered = df.orderBy(*_cols(order))
    return ordered if n is None else ordered.limit(n)


def first_n(df: DataFrame, tie, n: int | None) -> DataFrame:
    """A limit made repeatable by a total order."""
    return top_n(df, tie, n)


def limit_per_file(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows of each file of a frame read with ``with_source=True``.

    Rows are ranked inside blocks of a file, which are bounded by the split size, and the
    counts of the earlier blocks are added, so a huge file is never sorted in one task.
    """
    block = F.col("source_row.block")
    earlier = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        df.groupBy("source_file", block.alias("block"))
        .agg(F.count("*").alias("rows"))
        .select("source_file", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
        .where(F.col("before") < n)
    )
    inside = Window.partitionBy("source_file", "block").orderBy("source_row")
    return (
        df.withColumn("block", block)
        .join(before, ["source_file", "block"])
        .withColumn("in_block", F.row_number().over(inside))
        .where(F.col("before") + F.col("in_block") <= n)
        .select(*df.columns)
    )
