"""Ontology clean-up and bounded descent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.constants import PREDICATE_KINDS, ROOT_TOPIC, SCOPE_DEPTH
from topicloom.functions.columns import strip, topic_slug
from topicloom.functions.predicates import drop_self_edges, non_empty, predicate_kind
from topicloom.graph.components import components_by_stars
from topicloom.operators.aggregates import last_per_key
from topicloom.operators.joins import canonicalize
from topicloom.runtime import cut_lineage

SUPER, RELATED, PREFERRED = PREDICATE_KINDS


def topic_triples(triples: DataFrame) -> DataFrame:
    """``subj, kind, obj`` as topic names; triples without a topic or a known kind are left out."""
    parsed = triples.select(
        topic_slug(strip("subj")).alias("subj"),
        predicate_kind("pred").alias("kind"),
        topic_slug(strip("obj")).alias("obj"),
        *(["position"] if "position" in triples.columns else []),
    )
    return parsed.where(non_empty("subj", "obj") & F.col("kind").isNotNull())


def canonical_names(parsed: DataFrame) -> DataFrame:
    """``name, canonical`` for every topic that has a preferred or an equivalent name.

    A preferred name counts first, the last one given if there are several, and is not followed
    any further. A topic without one takes the smallest preferred name among all topics it is
    equivalent to, directly or over others, or else the smallest name of that cluster.
    """
    order = "position" if "position" in parsed.columns else "obj"
    stated = parsed.where(F.col("kind") == PREFERRED).select(
        F.col("subj").alias("name"), F.col("obj").alias("preferred"), F.col(order).alias("position")
    )
    preferred = last_per_key(stated, "name", "position")
    related = parsed.where(F.col("kind") == RELATED).select(F.col("subj").alias("src"), F.col("obj").alias("dst"))
    members = components_by_stars(related).withColumnRenamed("node", "name")
    known = members.join(preferred, "name", "full_outer")
    cluster = known.groupBy("component").agg(F.min("preferred").alias("cluster_preferred"))
    return known.join(cluster, "component", "left").select(
        "name", F.coalesce("preferred", "cluster_preferred", "component").alias("canonical")
    )


def canonical_hierarchy(triples: DataFrame) -> DataFrame:
    """Triples to a clean edge set ``parent, child`` between canonical topic names."""
    parsed = topic_triples(triples)
    names = cut_lineage(canonical_names(parsed))
    edges = parsed.where(F.col("kind") == SUPER).select(F.col("subj").alias("parent"), F.col("obj").alias("child"))
    return drop_self_edges(canonicalize(canonicalize(edges, "parent", names), "child", names))


def descendants(edges: DataFrame, root: str = ROOT_TOPIC, max_depth: int = SCOPE_DEPTH) -> DataFrame:
    """``topic, depth`` of everything within ``max_depth`` steps below ``root``, the root left out."""
    frontier = edges.sparkSession.createDataFrame([(root, 0)], "topic string, depth int")
    seen = frontier
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier, edges["parent"] == frontier["topic"]).select(F.col("child").alias("topic")).distinct()
        frontier = reached.join(seen, "topic", "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut_lineage(frontier)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where(F.col("depth") > 0)
