"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import cut_lineage, forget, stored

FEW_HOT = 50_000  # nodes of high degree whose labels are broadcast; a degree counts as high from a share of the edges on


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, each once, no edge from a node to itself."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.where(F.col("src") != F.col("dst")).select(both.alias("e")).select("e.src", "e.dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all ends of the edges; a component is named by its smallest node.

    Each round takes the smallest label among the neighbours and then follows that label one
    step further, so the number of rounds grows with the logarithm of the longest path.
    """
    links = cut_lineage(symmetric(edges))
    labels = links.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select(
        "node", F.least("node", "near").alias("component")
    )
    labels = cut_lineage(labels)
    while True:
        near = (
            links.join(labels, links["dst"] == labels["node"])
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        above = labels.select(F.col("node").alias("component"), F.col("component").alias("above"))
        jumped = cut_lineage(
            hooked.join(above, "component").select("node", "before", F.least("component", "above").alias("component"))
        )
        moved = not jumped.where(F.col("before") != F.col("component")).isEmpty()
        labels = jumped.select("node", "component")
        if not moved:
            return labels


def _with_lowest(links: DataFrame, end: str, rows: int, hot_degree: int) -> DataFrame:
    """``src, dst, low``: the smallest node that the node at ``end`` of a link points at, null if it points at none.

    Links of one node in very many links would all meet in one task, so such nodes are looked up by broadcast: of
    ``rows`` links at most ``FEW_HOT`` nodes can have more than their share.
    """
    lows = links.groupBy(F.col("src").alias("at")).agg(F.min("dst").alias("low"))
    hot_degree = max(hot_degree, 2 * rows // FEW_HOT)
    if rows <= hot_degree:
        return links.join(lows, F.col(end) == F.col("at"), "left").drop("at")
    hot = links.groupBy(F.col(end).alias("at")).agg(F.count("*").alias("n")).where(F.col("n") > hot_degree).drop("n")
    hot = F.broadcast(hot.join(lows, "at", "left").withColumn("is_hot", F.lit(True)))
    told = links.join(hot, F.col(end) == F.col("at"), "left").drop("at")
    others = told.where(F.col("is_hot").isNull()).drop("low", "is_hot").join(lows, F.col(end) == F.col("at"), "left").drop("at")
    return told.where("is_hot").drop("is_hot").unionByName(others)


def components_by_stars(edges: DataFrame, hot_degree: int = 100_000) -> DataFrame:
    """``node, component`` as ``connected_components``, by large and small stars in turns.

    Links run from the greater node to the smaller. A large star hangs the greater neighbours of a node on the smallest
    node it knows; a small star does so with the node itself and its smaller neighbours. Rows move by link, never a
    component to its label, and the rounds grow with the logarithm of the number of nodes. Edges of a node to itself
    are left out, nulls as well.
    """
    downward = edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    links = stored(downward.distinct(), "links")
    before = None
    while True:
        # The end is a round that leaves all links as they are, told by their count and the sum of their hashes.
        rows, mark = links.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if (rows, mark) == before:
            nodes = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
            return nodes.unionByName(links.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
        before = rows, mark
        large = stored(
            _with_lowest(links, "dst", rows, hot_degree).select("src", F.coalesce("low", "dst").alias("dst")).distinct(), "links"
        )
        ends = F.explode(F.array(F.col("src"), F.col("dst"))).alias("src")
        small = _with_lowest(large, "src", rows, hot_degree).select(ends, F.col("low").alias("dst"))
        done, links = links, stored(small.where(F.col("src") != F.col("dst")).distinct(), "links")
        forget(done, large)
