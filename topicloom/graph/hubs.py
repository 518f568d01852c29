"""Hub ranking per label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.constants import HUB_LABELS, HUB_TYPES
from topicloom.graph.betweenness import betweenness
from topicloom.graph.pagerank import pagerank
from topicloom.graph.projection import project_numbers
from topicloom.model import Graph
from topicloom.operators.topk import top_k_per_key


def hubs(
    graph: Graph,
    labels: Sequence[str] = HUB_LABELS,
    types: Sequence[str] = HUB_TYPES,
    k: int | None = 10,
    by: str = "degree",
    iters: int = 20,
    sources: int | None = None,
    measures: Sequence[str] = ("degree", "pagerank"),
) -> DataFrame:
    """``label, key``, the ``measures`` and ``rank`` of the best connected nodes of each label.

    Measures are ``degree``, ``pagerank`` and ``betweenness``; the one of ``by`` is always among
    them, and only those asked for are computed. Betweenness needs ``sources``, the number of
    nodes shortest paths start from. Ties go by key. ``k=None`` keeps all.
    """
    wanted = [m for m in ("degree", "pagerank", "betweenness") if m in measures or m == by or m == "betweenness" and sources is not None]
    if "betweenness" in wanted and sources is None:
        raise ValueError("betweenness needs sources, the number of nodes shortest paths start from")
    # Nodes are numbered once, and every measure runs on numbers; edges of two types never have the same ends.
    named, edges = project_numbers(graph, labels, types)
    scored = named
    if "degree" in wanted:
        degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        scored = scored.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    if "pagerank" in wanted:
        ranks = pagerank(named.select("id"), edges, iters=iters, numbered=True)
        scored = scored.join(ranks.withColumnRenamed("rank", "pagerank"), "id")
    if "betweenness" in wanted:
        # Sources are drawn by name, so names stand for numbers here.
        numbers = named.select("name", "id")
        by_name = edges.join(numbers.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(
            numbers.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst"
        ).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        between = betweenness(named.select(F.col("name").alias("id")), by_name, sources=sources, directed=False)
        scored = scored.join(between.withColumnRenamed("id", "name"), "name")
    scored = scored.select("label", "key", *wanted)
    if k is None:
        return scored
    # Values that differ in their last digits only, by the order of additions, are ties.
    value = F.col(by) if by == "degree" else F.round(by, 13)
    return top_k_per_key(scored, "label", [F.desc(value), "key"], k)
