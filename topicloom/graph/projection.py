"""One node and one edge frame out of chosen labels and relationship types."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.constants import EDGE_ENDS, NODE_KEYS
from topicloom.graph.components import symmetric
from topicloom.graph.pagerank import numbered_rows
from topicloom.model import Graph
from topicloom.runtime import free_shuffles, stored


def node_id(label: str, key: Column | str) -> Column:
    """Keys of different labels may be equal, so the label is part of the id."""
    return F.concat(F.lit(f"{label}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _nodes(graph: Graph, labels: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        graph.nodes[label].select(
            node_id(label, NODE_KEYS[label]).alias("id"), F.lit(label).alias("label"),
            F.col(NODE_KEYS[label]).cast("string").alias("key"),
        )
        for label in labels
    ])


def project_numbers(graph: Graph, labels: Sequence[str], types: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """As ``project_graph``, undirected: stored nodes ``name, label, key, id``, numbered, and stored edges ``src, dst``
    of numbers.

    An end is joined with the nodes of its label once, and only numbers are made distinct and turned around.
    """
    nodes = numbered_rows(_nodes(graph, labels).drop("id"))
    nodes = nodes.select(F.concat("label", F.lit(":"), "key").alias("name"), "label", "key", "id")
    inside = [t for t in types if set(EDGE_ENDS[t]) <= set(labels)]
    if not inside:
        return nodes, nodes.sparkSession.createDataFrame([], "src long, dst long")

    def typed(kind: str) -> DataFrame:
        ends = graph.edges[kind].select("src", "dst")
        for end, label in zip(("src", "dst"), EDGE_ENDS[kind]):
            known = nodes.where(F.col("label") == label).select(F.col("key").alias(f"{end}_key"), F.col("id").alias(f"{end}_id"))
            ends = ends.join(known, F.col(end).cast("string") == F.col(f"{end}_key"))
        ends = ends.where("src_id <> dst_id")
        if len(set(EDGE_ENDS[kind])) == 1:  # an edge may be there in both directions, or lead to the same name
            ends = ends.where("src_key <> dst_key").select(F.least("src_id", "dst_id").alias("src_id"), F.greatest("src_id", "dst_id").alias("dst_id"))
        return ends.select("src_id", "dst_id").distinct()

    # On disk names are made of labels and keys, and an edge lies once.
    once = stored(reduce(DataFrame.unionByName, [typed(t) for t in inside]), "edges")
    free_shuffles(nodes.sparkSession)
    both = F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("src_id", "dst_id"), ("dst_id", "src_id"))]))
    return nodes, once.select(both.alias("e")).select("e.src", "e.dst")


def project_graph(
    graph: Graph, labels: Sequence[str], types: Sequence[str], orientation: str = "UNDIRECTED"
) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, label, key`` and edges ``src, dst, type`` of a sub-graph.

    An edge with an end outside of the labels is left out. ``UNDIRECTED`` gives each edge in both
    directions, ``NATURAL`` as stored, ``REVERSE`` turned around.
    """
    nodes = _nodes(graph, labels)
    inside = [t for t in types if set(EDGE_ENDS[t]) <= set(labels)]
    if not inside:
        return nodes, nodes.sparkSession.createDataFrame([], "src string, dst string, type string")

    def typed(kind: str) -> DataFrame:
        a, b = EDGE_ENDS[kind]
        ends = graph.edges[kind].select("src", "dst")
        ends = ends.join(graph.nodes[a].select(F.col(NODE_KEYS[a]).alias("src")), "src", "left_semi")
        ends = ends.join(graph.nodes[b].select(F.col(NODE_KEYS[b]).alias("dst")), "dst", "left_semi")
        ends = ends.select(node_id(a, "src").alias("src"), node_id(b, "dst").alias("dst"))
        if orientation == "UNDIRECTED":
            ends = symmetric(ends)
        elif orientation == "REVERSE":
            ends = ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return ends.withColumn("type", F.lit(kind))

    return nodes, reduce(DataFrame.unionByName, [typed(t) for t in inside])
