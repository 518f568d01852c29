"""Node similarity: the nearest nodes by the Jaccard overlap of their neighbour sets.

Comparing all nodes that share a neighbour is quadratic in the degree of that neighbour, and one
topic may belong to a third of all papers. Exact routes cover all pairs instead:

* *one rare neighbour* (degree up to ``hot_degree``): a pair that shares nothing else is the more alike the smaller
  its sets are. So of the nodes at a neighbour the first ``k + 1`` by (set size, node) are enough, since the others are
  outranked by those, and a node gets one short list from each of its neighbours;
* *two and more neighbours, the first a rare one*: prefix-filtered join, in which a pair meets at its first common
  neighbour in order of degree and is measured right there, if the bits of the neighbours after it have one in common;
* *frequent neighbours only*: pairs that share nothing rare are alike to the extent of the
  frequent neighbours they share. For every subset of these the first ``k + 1`` nodes by (set size, node) are enough;
* *wide nodes*, with too many neighbours for the above: common neighbours are counted.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.constants import SIMILARITY_TOP_K
from topicloom.operators.topk import top_k_per_key
from topicloom.runtime import forget, stored


FEW = 8  # neighbours whose bits are joined in compiled code; more take a fold


def _jaccard(common: Column, a: Column, b: Column) -> Column:
    return common / (a + b - common)


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each unordered pair ``a, b`` as a neighbour of either node."""
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("neighbour")),
        F.struct(F.col("b").alias("node"), F.col("a").alias("neighbour")),
    ))
    return pairs.select(ends.alias("p"), "similarity").select("p.node", "p.neighbour", "similarity")


def _bit(number: Column) -> Column:
    """One of 64 bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))


def _pair_route(sets: DataFrame, cutoff: float) -> DataFrame:
    """Pairs with two and more common neighbours of which the first is a rare one, measured exactly.

    ``all`` lists the numbers of the neighbours of a node in order, the first ``rare`` of them
    being rare. With a similarity above ``cutoff`` the first common neighbour lies within the first
    ``size - floor(cutoff * size)`` of both lists, and it is the last of neither.
    """
    prefix = F.col("size") - F.floor(F.greatest(F.col("size") * F.lit(cutoff) - F.lit(1e-9), F.lit(0.0))).cast("int")
    reach = F.least("rare", prefix, F.col("size") - 1)
    entries = sets.select("node", "size", "all", F.posexplode(F.slice("all", F.lit(1), reach)).alias("at", "via"))
    # Pairs whose neighbours after the meeting point have no bit in common share none; long lists have all bits.
    none = F.lit(0).cast("long")
    after = F.aggregate(F.slice("all", F.col("at") + 2, F.col("size")), none, lambda bits, x: bits.bitwiseOR(_bit(x)))
    few = reduce(Column.bitwiseOR, [F.coalesce(_bit(F.get("all", F.col("at") + i)), none) for i in range(1, FEW)])
    entries = entries.withColumn(
        "bits", F.when(F.col("size") - F.col("at") <= FEW, few).when(F.col("size") - F.col("at") > 64, F.lit(-1).cast("long")).otherwise(after))
    a = entries.select([F.col(c).alias(f"a_{c}") for c in entries.columns])
    b = entries.select([F.col(c).alias(f"b_{c}") for c in entries.columns])
    # Nothing before the meeting point is common, so the rest of the shorter list bounds the overlap.
    most = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    earlier = F.arrays_overlap(F.slice("a_all", F.lit(1), F.col("a_at")), F.slice("b_all", F.lit(1), F.col("b_at")))
    rest = F.size(F.array_intersect(
        F.slice("a_all", F.col("a_at") + 1, F.col("a_size")), F.slice("b_all", F.col("b_at") + 1, F.col("b_size"))
    ))
    met = a.hint("merge").join(b, (F.col("a_via") == F.col("b_via")) & (F.col("a_node") < F.col("b_node"))).where(
        (F.col("a_bits").bitwiseAND(F.col("b_bits")) != 0) & (_jaccard(most, F.col("a_size"), F.col("b_size")) > cutoff)
    )
    # The explode keeps the lists out of the condition of the join, which would test them first, in code too long to compile.
    counted = met.select(
        F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_size", "b_size", F.explode(F.array(F.when(~earlier, rest))).alias("common"))
    measured = counted.where(F.col("common") > 1).withColumn("similarity", _jaccard(F.col("common"), F.col("a_size"), F.col("b_size")))
    return _both_ways(measured.where(F.col("similarity") > cutoff))


def _first_lists(sets: DataFrame, cutoff: float, k: int) -> DataFrame:
    """``node, size, shared, sizes, nodes``: per node and rare neighbour the first ``k + 1`` nodes there, in order.

    Only nodes and lists that one common neighbour can bring above the cutoff; there are at most ``hot_degree`` nodes
    at a rare neighbour.
    """
    small = sets.where(_jaccard(F.lit(1), F.col("size"), F.lit(1)) > cutoff)
    entries = small.select("node", "size", F.explode(F.slice("all", F.lit(1), F.col("rare"))).alias("via"))
    members = entries.groupBy("via").agg(F.sort_array(F.collect_list(F.struct("size", "node"))).alias("members"))
    lists = members.where(F.size("members") > 1).select(
        F.explode("members").alias("m"), F.slice("members", 1, k + 1).alias("first"))
    return lists.select("m.node", "m.size", F.lit(1).alias("shared"), F.col("first.size").alias("sizes"), F.col("first.node").alias("nodes")).where(
        _jaccard(F.lit(1), F.col("size"), F.get("sizes", 0)) > cutoff)


def _subsets(items: Column) -> Column:
    """All non-empty sub-lists of a short list, in list order."""
    start = F.array(F.array().cast("array<bigint>"))
    grown = F.aggregate(
        items, start, lambda found, x: F.concat(found, F.transform(found, lambda s: F.array_append(s, x)))
    )
    return F.filter(grown, lambda s: F.size(s) > 0)


def _best(offers: Column, k: int) -> Column:
    """The first ``k`` of ``{neighbour, far}`` as ``{far, neighbour}`` in order, each neighbour once at its least ``far``."""
    def once(found: Column) -> Column:
        firsts = F.filter(found, lambda x, i: (i == 0) | (x["neighbour"] != F.get(found, i - 1)["neighbour"]))
        return F.transform(firsts, lambda x: F.struct(x["far"], x["neighbour"]))

    return F.slice(F.sort_array(F.get(F.transform(F.array(F.sort_array(offers)), once), 0)), 1, k)


def _offers(lists: Column, size: Column, cutoff: float, k: int) -> Column:
    """``{neighbour, far}`` of lists ``{shared, sizes, nodes}``, of each the first ``k + 1`` above the cutoff."""
    def of(x: Column) -> Column:
        found = F.transform(F.arrays_zip(x["sizes"], x["nodes"]), lambda y: F.struct(
            y["nodes"].alias("neighbour"), (-_jaccard(x["shared"], size, y["sizes"])).alias("far")))
        return F.filter(found, lambda y: -y["far"] > cutoff)

    return F.flatten(F.transform(lists, of))


def _frequent_route(sets: DataFrame, cutoff: float, k: int) -> DataFrame:
    """``node, best``: candidates by shared frequent neighbours as ``{far, neighbour}``, ``far`` being ``-similarity``.

    The similarity given is that of the shared subset, a lower bound that is met exactly by the
    subset of all shared neighbours; taking the maximum over routes restores the true order.
    """
    nodes = sets.where(F.size("hot") > 0).select("node", "size", "hot")
    members = top_k_per_key(nodes, ["hot", "size"], "node", k + 1).drop("rank")
    # A similarity above the cutoff takes more than cutoff * size shared neighbours; smaller subsets, whose
    # groups are the largest, are not even listed.
    telling = F.filter(_subsets(F.col("hot")), lambda s: F.size(s) > F.col("size") * F.lit(cutoff))
    # A class is the nodes of equal frequent neighbours and size, and is named by its first node.
    classes = stored(members.groupBy("hot", "size").agg(F.sort_array(F.collect_list("node")).alias("nodes")), "classes")
    spread = classes.select(F.get("nodes", 0).alias("class"), "size", "nodes", F.explode(telling).alias("shared"))
    groups = top_k_per_key(spread.select("shared", "size", F.explode("nodes").alias("node")), "shared", ["size", "node"], k + 1)
    groups = groups.groupBy("shared").agg(F.sort_array(F.collect_list(F.struct("size", "node"))).alias("first"))
    groups = groups.where(F.size("first") > 1).select("shared", F.col("first.size").alias("sizes"), F.col("first.node").alias("nodes"))
    lists = spread.select("class", "size", "shared").join(groups, "shared").select(
        "class", "size", F.size("shared").alias("shared"), "sizes", "nodes"
    ).where(_jaccard(F.col("shared"), F.col("size"), F.get("sizes", 0)) > cutoff)
    best = lists.repartition("class").groupBy("class", "size").agg(
        F.collect_list(F.struct("shared", "sizes", "nodes")).alias("lists")
    ).select("class", _best(_offers(F.col("lists"), F.col("size"), cutoff, k), k + 1).alias("best"))
    named = classes.select("hot", "size", F.get("nodes", 0).alias("class")).join(best, "class").drop("class")
    return nodes.join(named, ["hot", "size"]).select("node", "best")


def _wide_route(ranked: DataFrame, stats: DataFrame, cutoff: float) -> DataFrame:
    """Pairs with a wide node, by counting common neighbours.

    A pair with one common neighbour may be too little for the cutoff; it is left out before it is counted if in one of
    three draws of bits for neighbours, without two of a node at the same bit, the pair has one bit in common only.
    """
    links = ranked.select("node", "via").join(stats.select("node", "size", "wide", *BITS), "node")
    b = links.select([F.col(c).alias(f"b_{c}") if c != "via" else F.col(c) for c in links.columns])
    a = b.where("b_wide").select([F.col(c).alias(f"a_{c[2:]}") if c != "via" else F.col(c) for c in b.columns]).drop("a_wide")
    a_size, b_size = F.col("a_size"), F.col("b_size")
    enough = _jaccard(F.lit(1), a_size, b_size) > cutoff

    def may_share_two(bits: str) -> Column:
        clash = (F.bit_count(f"a_{bits}") < a_size) | (F.bit_count(f"b_{bits}") < b_size)
        return clash | (F.bit_count(F.col(f"a_{bits}").bitwiseAND(F.col(f"b_{bits}"))) > 1)

    met = a.join(b, "via").where(
        (F.col("a_node") != F.col("b_node")) & (_jaccard(F.least(a_size, b_size), a_size, b_size) > cutoff)
        & (enough | reduce(Column.__and__, map(may_share_two, BITS)))
    )
    common = met.groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_size", "b_size", "b_wide").agg(F.count("*").alias("common"))
    measured = common.withColumn("similarity", _jaccard(F.col("common"), a_size, b_size)).where(F.col("similarity") > cutoff)
    # A pair of wide nodes is met from both sides, any other pair from the wide side only.
    return measured.where("b_wide").select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "similarity").unionByName(
        _both_ways(measured.where(~F.col("b_wide")))
    )


BITS = ("bits_0", "bits_1", "bits_2")


def _ranked(lists: DataFrame, offers: list[DataFrame], cutoff: float, k: int) -> DataFrame:
    """The best ``k`` of each node out of ``lists`` and of offers ``node, best``; one shuffle of short rows."""
    kind = lists.schema["node"].dataType.simpleString()
    rows = lists.select("node", "size", "sizes", "nodes")
    for found in offers:
        rows = rows.unionByName(found.select("node", F.col("best.far").alias("fars"), F.col("best.neighbour").alias("nodes")), allowMissingColumns=True)
    rows = rows.repartition("node").sortWithinPartitions("node")

    def best(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            # The rows of the last node may go on in the next batch.
            last = pc.equal(table["node"], table["node"][-1]).combine_chunks()
            ready, held = table.filter(pc.invert(last)), table.filter(last)
            yield from _best_rows(ready, cutoff, k).to_batches()
        if held is not None:
            yield from _best_rows(held, cutoff, k).to_batches()

    return rows.mapInArrow(best, f"node {kind}, neighbour {kind}, similarity double, rank int")


def _best_rows(table: pa.Table, cutoff: float, k: int) -> pa.Table:
    """``node, neighbour, similarity, rank`` of whole nodes; a row holds ``nodes`` with their ``sizes`` or ``fars``."""
    table = table.combine_chunks()
    counts = pc.list_value_length(table["nodes"]).to_numpy()
    row = np.repeat(np.arange(len(counts)), counts)
    by_size = table["fars"].is_null().to_numpy()[row]
    far = np.empty(len(row))
    sizes = table["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    own = pc.fill_null(table["size"], 0).to_numpy()[row[by_size]]
    far[by_size] = -(1.0 / (own.astype("int64") + sizes - 1))
    far[~by_size] = table["fars"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    node, neighbour = table["node"].take(pa.array(row)), table["nodes"].combine_chunks().flatten()
    kept = np.flatnonzero(pc.not_equal(node, neighbour).to_numpy() & (-far > cutoff))
    far, row = far[kept], row[kept]
    node, neighbour = node.take(pa.array(kept)), neighbour.take(pa.array(kept))
    # Rows stand in order of their nodes, neighbours are compared by their place.
    changes = pc.not_equal(table["node"].slice(1), table["node"].slice(0, max(len(counts) - 1, 0))).to_numpy().astype(bool)
    group = np.concatenate([[0], np.cumsum(changes)]).astype("int64")[row]
    place = pc.rank(neighbour, tiebreaker="min").to_numpy().astype("int64") if len(kept) else row
    order = np.lexsort((far, place, group))
    once = np.ones(len(order), bool)
    once[1:] = (group[order][1:] != group[order][:-1]) | (place[order][1:] != place[order][:-1])
    order = order[once]
    order = order[np.lexsort((place[order], far[order], group[order]))]
    rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    order, rank = order[rank < k], rank[rank < k]
    at = pa.array(order)
    return pa.table([node.take(at), neighbour.take(at), pa.array(-far[order]), pa.array(rank + 1, pa.int32())], names=["node", "neighbour", "similarity", "rank"])


def node_similarity(
    edges: DataFrame,
    top_k: int = SIMILARITY_TOP_K,
    cutoff: float = 0.0,
    hot_degree: int = 256,
    hot_width: int = 8,
    set_width: int = 1024,
) -> DataFrame:
    """``node, neighbour, similarity, rank`` for the source ends of ``edges(src, dst)``.

    Keeps similarities above ``cutoff`` and per node the best ``top_k``, by (similarity desc,
    neighbour). ``hot_degree``, ``hot_width`` and ``set_width`` decide which route a pair takes,
    never the result.
    """
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("name")).where("node IS NOT NULL")
    links = stored(links.distinct(), "links")
    degrees = links.groupBy("name").agg(F.count("*").alias("degree"))
    # Neighbours become numbers that grow with (degree, name): short rows, and sorted lists for free.
    numbered = stored(degrees.orderBy("degree", "name").withColumn("via", F.monotonically_increasing_id()), "numbered")
    ranked = links.join(numbered, "name").select("node", "via", (F.col("degree") > hot_degree).alias("is_hot"))
    ranked = stored(ranked, "ranked")

    tallies = ranked.groupBy("node").agg(F.count("*").cast("int").alias("size"), F.count_if("is_hot").alias("hots"))
    wide = (F.col("size") > set_width) | (F.col("hots") > hot_width)
    has_hot, has_wide = tallies.agg(F.bool_or(F.col("hots") > 0), F.bool_or(wide)).first()

    narrow = ranked
    if has_wide:
        draws = [F.xxhash64("via"), F.shiftright(F.xxhash64("via"), 6), F.shiftright(F.xxhash64("via"), 12)]
        stats = stored(ranked.groupBy("node").agg(
            F.count("*").cast("int").alias("size"), F.count_if("is_hot").alias("hots"),
            *[F.bit_or(_bit(draw)).alias(bits) for bits, draw in zip(BITS, draws)],
        ).withColumn("wide", wide), "stats")
        narrow = ranked.join(stats.where("wide").select("node"), "node", "left_anti")
    # The numbers grow with the degree, so the frequent neighbours of a node are the last of its list.
    sets = narrow.groupBy("node").agg(
        F.sort_array(F.collect_list("via")).alias("all"), F.count_if(~F.col("is_hot")).cast("int").alias("rare")
    ).select("node", F.size("all").alias("size"), "rare", "all", F.slice("all", F.col("rare") + 1, F.size("all")).alias("hot"))
    sets = stored(sets, "sets")

    measured = _pair_route(sets, cutoff)
    if has_wide:
        measured = measured.unionByName(_wide_route(ranked, stats, cutoff))
    measured = top_k_per_key(measured, "node", [F.desc("similarity"), "neighbour"], top_k)
    offers = [measured.select("node", F.array(F.struct((-F.col("similarity")).alias("far"), "neighbour")).alias("best"))]
    if has_hot:
        offers.append(_frequent_route(sets, cutoff, top_k))
    return _ranked(_first_lists(sets, cutoff, top_k), offers, cutoff, top_k)


def similar_to(edges: DataFrame, sources: DataFrame, top_k: int = SIMILARITY_TOP_K, cutoff: float = 0.0) -> DataFrame:
    """``node, neighbour, similarity, rank`` as ``node_similarity``, for the nodes of ``sources(node)`` only.

    For some thousands of sources. A source meets other nodes at the first ``size - floor(cutoff * size)`` of its
    neighbours, rarest first, and those that it met are measured; other nodes are never compared with each other.
    """
    links = edges.select(F.col("src").alias("node"), F.col("dst").alias("name"))
    # Every step reads the edges through a semi join with a stored table of known size, before rows are made distinct.
    ours = stored(links.join(sources.select("node"), "node", "left_semi").distinct().withColumnRenamed("node", "a"))
    around = stored(links.join(ours.select("name").distinct(), "name", "left_semi").distinct().withColumnRenamed("node", "b"))
    degrees = around.groupBy("name").agg(F.count("*").alias("degree"))
    ranked = ours.join(degrees, "name").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("degree", "name"))).alias("items"))
    ranked = ranked.withColumn("a_size", F.size("items"))
    prefix = F.col("a_size") - F.floor(F.greatest(F.col("a_size") * F.lit(cutoff) - F.lit(1e-9), F.lit(0.0))).cast("int")
    probes = ranked.select("a", "a_size", F.explode(F.slice("items", F.lit(1), prefix)).alias("item")).select("a", "a_size", "item.name")
    met = stored(probes.join(around, "name").where(F.col("a") != F.col("b")).select("a", "a_size", "b").distinct())
    others = stored(met.select("b").distinct())
    sizes = links.withColumnRenamed("node", "b").join(others, "b", "left_semi").distinct().groupBy("b").agg(F.count("*").alias("b_size"))
    theirs = around.join(others, "b", "left_semi")
    common = theirs.join(ours, "name").join(met, ["a", "b"]).groupBy("a", "a_size", "b").agg(F.count("*").alias("common"))
    measured = common.join(sizes, "b").select(
        F.col("a").alias("node"), F.col("b").alias("neighbour"),
        _jaccard(F.col("common"), F.col("a_size"), F.col("b_size")).alias("similarity"),
    )
    found = stored(top_k_per_key(measured.where(F.col("similarity") > cutoff), "node", [F.desc("similarity"), "neighbour"], top_k))
    forget(ours, around, met, others)
    return found
