"""Betweenness centrality by Brandes' method: exact with all sources side by side, or within a bound of the error."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.runtime import forget, stored

WORD = 64  # sources that share a row per class
FIRST_SOURCES = 256  # of the first round of ``betweenness_within``; every round doubles what was drawn


def pick_sources(nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` nodes drawn by a hash of the id, the same ones on every run."""
    return nodes.select("id").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(k)


def betweenness(
    nodes: DataFrame, edges: DataFrame, sources: int | DataFrame | None = None, seed: int = 0, directed: bool = True
) -> DataFrame:
    """``id, betweenness`` for every node.

    Shortest paths start from all nodes, from the ``id`` rows of a frame, or from ``sources``
    drawn nodes. For an undirected graph give edges in both directions and ``directed=False``,
    which counts each pair once.

    Nodes with the same neighbours, as leaves below the same parents, lie on the same shortest paths but for their own
    ends, so they are one class with a size, and paths start from one of each class of sources. The state is one row per
    class of sources and reached class; sampling is the way out for large connected graphs whose nodes differ.
    """
    links = stored(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct(), "links")
    ids = nodes.select("id").distinct()
    if sources is None:
        starts = ids
    else:
        starts = pick_sources(nodes, sources, seed) if isinstance(sources, int) else sources.select("id").distinct()
    classes = _classes(links, starts)
    sizes = stored(classes.groupBy("class").agg(F.count("*").cast("double").alias("size"), F.first("start").alias("start")), "sizes")
    links = _between_classes(links, classes)

    # The start itself is class null; its own class, if reached, is the others of it.
    start = sizes.where("start").select(F.col("class").alias("source"))
    level = stored(
        start.join(links, F.col("source") == F.col("src")).select("source", F.col("dst").alias("node"), F.lit(1.0).alias("paths")), "level")
    size = sizes.select(F.col("class").alias("node"), "size")
    others = F.col("size") - (F.col("source") == F.col("node")).cast("double")
    levels = []
    while not level.isEmpty():
        levels.append(level)
        # Without directions an edge leads to a neighbouring level only.
        seen = reduce(DataFrame.unionByName, [lv.select("source", "node") for lv in (levels if directed else levels[-2:])])
        level = level.join(size, "node").join(links, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(
            F.sum(F.col("paths") * others).alias("paths"))
        # A class of one that is the start has nobody else to reach.
        level = level.join(size, "node").where(others > 0).drop("size").join(seen, ["source", "node"], "left_anti")
        level = stored(level.select("source", "node", "paths"), "level")

    # Backwards: what a node passes on to its predecessors on shortest paths.
    zero, carried, parts = F.lit(0.0), None, []
    for nearer in reversed(levels):
        if carried is None:
            carried = nearer.withColumn("delta", zero)
        else:
            given = carried.join(size, "node").select(
                "source", F.col("node").alias("dst"), (others * (1.0 + F.col("delta")) / F.col("paths")).alias("given")
            )
            passed = (
                nearer.join(links, nearer["node"] == links["src"])
                .select("source", "node", "dst")
                .join(given, ["source", "dst"])
                .groupBy("source", "node")
                .agg(F.sum("given").alias("given"))
            )
            carried = stored(
                nearer.join(passed, ["source", "node"], "left").select(
                    "source", "node", "paths", (F.col("paths") * F.coalesce("given", zero)).alias("delta")
                ), "carried")
        # A node depends on every start of another class, and on the others of its own.
        many = size.select(F.col("node").alias("source"), "size")
        parts.append(carried.join(many, "source").groupBy("node").agg(F.sum(F.col("delta") * others).alias("delta")))
    if not parts:
        return ids.withColumn("betweenness", zero)
    total = reduce(DataFrame.unionByName, parts).groupBy(F.col("node").alias("class")).agg(F.sum("delta").alias("delta"))
    total = classes.join(total, "class").select(F.col("node").alias("id"), "delta")
    scale = 1.0 if directed else 0.5
    return ids.join(total, "id", "left").select("id", (F.coalesce("delta", zero) * scale).alias("betweenness"))


def _between_classes(links: DataFrame, classes: DataFrame) -> DataFrame:
    ends = lambda end: classes.select(F.col("node").alias(end), F.col("class").alias(f"{end}_class"))
    # One join after the other, by sort: broadcasts of links would grow with them.
    between = links.hint("merge").join(ends("src"), "src").hint("merge").join(ends("dst"), "dst")
    return stored(between.select(F.col("src_class").alias("src"), F.col("dst_class").alias("dst")).distinct(), "links")


def _classes(links: DataFrame, starts: DataFrame) -> DataFrame:
    """``node, class, start`` of all ends: nodes with the same neighbours in both directions that are all sources or none.

    Neighbours are compared by their number and two sums of 64-bit hashes, so no list is as long as a degree.
    """
    marks = lambda c: [F.count("*").alias("n"), *[F.sum(F.xxhash64(F.lit(i), c).cast("decimal(38,0)")).alias(f"h{i}") for i in (1, 2)]]
    sides = [
        links.groupBy(F.col(end).alias("node")).agg(*marks(other)).select("node", F.lit(end == "src").alias("out"), F.struct("n", "h1", "h2").alias("mark"))
        for end, other in (("src", "dst"), ("dst", "src"))
    ]
    marked = sides[0].unionByName(sides[1]).groupBy("node").agg(F.max(F.when(F.col("out"), F.col("mark"))).alias("to"), F.max(F.when(~F.col("out"), F.col("mark"))).alias("by"))
    marked = marked.join(starts.select(F.col("id").alias("node"), F.lit(True).alias("start")), "node", "left")
    kind = F.to_json(F.struct("to", "by", F.coalesce("start", F.lit(False)).alias("start")))
    marked = stored(marked.select("node", F.coalesce("start", F.lit(False)).alias("start"), kind.alias("kind")), "marked")
    numbers = stored(marked.select("kind").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    found = stored(marked.join(numbers, "kind").select("node", "class", "start"), "classes")
    forget(marked, numbers)
    return found


def betweenness_within(
    nodes: DataFrame, edges: DataFrame, error: float, confidence: float = 0.95, seed: int = 0, directed: bool = True,
) -> DataFrame:
    """``id, betweenness, bound``: estimates that are off by at most ``bound`` for all nodes at once, with probability
    ``confidence``.

    Sources are drawn without replacement until every bound is at most ``error`` times the number of pairs that a node
    can stand between, ``(n - 1) (n - 2)``; if that takes all nodes the result is exact and its bounds are 0. The bound is
    the empirical one of Bernstein and Serfling (Bardenet and Maillard, 2015) on a node's dependencies, shared among nodes
    and rounds. For an undirected graph give edges in both directions and ``directed=False``.

    As in ``betweenness``, nodes with the same neighbours are one class, and paths start from one node of each class that
    was drawn; a drawn node depends on itself by nothing, which is taken off its sums. The state is one row per class and 64
    sources: a word tells which of them have reached the class, an array holds their numbers of shortest paths to each of
    its nodes. Rounds whose bound could not be small enough for any node run together with the next. A round's files are
    removed when its sums are written.
    """
    if not 0 < confidence < 1 or error < 0:
        raise ValueError("confidence lies between 0 and 1, error is not negative")
    links = stored(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct(), "links")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 13), 16, 10)
    ids = stored(nodes.select("id").where(F.col("id").isNotNull()).distinct().withColumn("draw", draw.cast("double") / 16.0**13), "ids")
    n = ids.count()
    classes = _classes(links, ids.select("id").limit(0)).select(F.col("node").alias("id"), "class")
    placed = stored(ids.join(classes, "id", "left"), "placed")
    sizes = stored(classes.groupBy(F.col("class").alias("node")).agg(F.count("*").cast("double").alias("size")), "sizes")
    links, nodes_links = _between_classes(links, classes.withColumnRenamed("id", "node")), links
    forget(nodes_links, ids)
    sums, taken, share, since, rounds, limit = None, 0, 0.0, 0.0, 0, error * (n - 1) * (n - 2)
    while taken < n:
        rounds += 1
        # No bound but that of all nodes is 0.
        upto = 1.0 if 2 * taken >= n or error == 0 else min(1.0, max(FIRST_SOURCES, 2 * taken) / n)
        count = placed.where((F.col("draw") >= share) & (F.col("draw") < upto)).count()
        share = upto
        if not count:
            continue
        taken += count
        widest = _bound_of_nothing(n, taken, rounds, confidence)
        if widest > limit:
            continue
        drawn = placed.where((F.col("draw") >= since) & (F.col("draw") < share))
        start = stored(_words(drawn, drawn.count()), "sources")
        since = share
        levels = _levels_of_words(start, links, sizes, directed)
        # A class has one part for each level and word; added up before the shuffle.
        added = _dependencies(levels, links, start)
        if added:
            earlier = [sums] if sums is not None else []
            total = reduce(DataFrame.unionByName, [*(a for a, _ in added), *earlier]).groupBy("node").agg(
                F.sum("delta").alias("delta"), F.sum("square").alias("square"), F.max("own").alias("own"))
            sums, before = stored(total, "dependencies"), sums
            forget(*(c for _, c in added), *([before] if before is not None else []))
        forget(start, *levels)
        if sums is None:
            break
        # Of the nodes of a class the drawn ones have sums of their own.
        of_class = placed.where(F.col("draw") < share).groupBy(F.col("class").alias("node")).agg(F.count("*").alias("n_drawn"))
        both = sums.join(sizes, "node").join(of_class, "node", "left").withColumn("n_drawn", F.coalesce("n_drawn", F.lit(0)))
        kinds = F.array(F.when(F.col("n_drawn") < F.col("size"), F.lit(False)), F.when(F.col("n_drawn") > 0, F.lit(True)))
        both = _without_own(both.withColumn("is_drawn", F.explode(F.array_compact(kinds))), F.col("is_drawn"))
        largest = F.max(F.coalesce(_bound(n, taken, rounds, confidence), F.lit(0.0)))
        if max(widest, both.agg(largest.alias("b")).first()["b"] or 0.0) <= limit:
            break
    forget(links)
    zero, scale = F.lit(0.0), 1.0 if directed else 0.5
    if sums is None:
        widest = _bound_of_nothing(n, taken, max(rounds, 1), confidence) if n else 0.0
        return placed.select("id", zero.alias("betweenness"), F.lit(widest * scale).alias("bound"))
    found = placed.join(sums.withColumnRenamed("node", "class"), "class", "left")
    found = _without_own(found, F.col("draw") < share).fillna(0.0, ["delta", "square"])
    return found.select(
        "id", (F.col("delta") * (scale * n / taken)).alias("betweenness"),
        (_bound(n, taken, rounds, confidence) * scale).alias("bound"),
    )


def _without_own(sums: DataFrame, drawn: Column) -> DataFrame:
    """Sums of classes as those of a node, which are less by its own source if it was ``drawn``."""
    own = F.when(drawn, F.coalesce("own", F.lit(0.0))).otherwise(0.0)
    return sums.withColumns({"delta": F.col("delta") - own, "square": F.col("square") - own * own})


def _logarithm(n: int, rounds: int, confidence: float) -> float:
    """Of the chance that is left to one node in one round: ten events each, and rounds take 1/2, 1/6, 1/12, ... of it."""
    return math.log(10 * n * rounds * (rounds + 1) / (1 - confidence))


def _bound_of_nothing(n: int, taken: int, rounds: int, confidence: float) -> float:
    """The bound of a node whose drawn sources all depend on it by 0."""
    if taken >= n:
        return 0.0
    return n * (7 / 3 + 3 / math.sqrt(2)) * max(n - 2, 0) * _logarithm(n, rounds, confidence) / taken


def _bound(n: int, taken: int, rounds: int, confidence: float) -> Column:
    """How far ``delta``, scaled to all sources, may be off, by the sums ``delta`` and ``square`` of ``taken`` sources."""
    if taken >= n:
        return F.lit(0.0)
    rho = 1 - (taken - 1) / n if 2 * taken <= n else (1 - taken / n) * (1 + 1 / taken)
    mean = F.col("delta") / taken
    variance = F.greatest(F.col("square") / taken - mean * mean, F.lit(0.0))
    spread = F.sqrt(variance * (2 * rho * _logarithm(n, rounds, confidence) / taken)) * n
    return spread + _bound_of_nothing(n, taken, rounds, confidence)


def _words(drawn: DataFrame, count: int) -> DataFrame:
    """``word, node, place, times, reached, paths`` of the classes of ``count`` drawn nodes, each a source at itself, numbered
    in buckets of about ten words each; ``times`` tells how many of its nodes were drawn."""
    sources = drawn.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.count("*").cast("double").alias("times"), F.min(F.struct("draw", "id")).alias("first"))
    if count > 10 * WORD:
        sources = stored(sources, "sources")
        count = sources.count()
    bucket = F.pmod(F.xxhash64("class"), F.lit(max(1, math.ceil(count / (10 * WORD)))))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("first")) - 1
    placed = sources.withColumn("bucket", bucket).withColumn("at", place).withColumn("place", F.col("at") % WORD)
    return placed.select(
        F.struct("bucket", F.floor(F.col("at") / WORD).alias("at")).alias("word"), F.col("class").alias("node"), "place", "times",
        F.expr("shiftleft(1L, place)").alias("reached"),
        F.transform(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: (i == F.col("place")).cast("double")).alias("paths"),
    )


def _array_sum(name: str) -> Column:
    return F.array(*[F.sum(F.get(name, i)) for i in range(WORD)])


def _others(i: Column) -> Column:
    """How many nodes of the class of a row are not the source at place ``i``."""
    return F.col("size") - (F.col("own") == i).cast("double")


def _levels_of_words(start: DataFrame, links: DataFrame, sizes: DataFrame, directed: bool) -> list[DataFrame]:
    """Breadth-first levels from 1 on; in the row of a level only the sources that reach the class there count. ``own`` is
    the place of the source that is of this class, or -1."""
    levels, own = [], start.select("word", "node", F.col("place").alias("own"))
    while True:
        if levels:
            from_all = F.transform("paths", lambda p, i: p * _others(i))
            ahead = levels[-1].select("word", "node", from_all.alias("paths"))
        else:
            ahead = start.select("word", "node", "paths")
        ahead = ahead.join(links, F.col("node") == F.col("src")).groupBy("word", F.col("dst").alias("node")).agg(
            _array_sum("paths").alias("paths"))
        ahead = ahead.join(sizes, "node").join(own, ["word", "node"], "left").withColumn("own", F.coalesce("own", F.lit(-1)))
        if levels:
            # Without directions an edge leads to a neighbouring level only.
            seen = levels if directed else levels[-2:]
            seen = reduce(DataFrame.unionByName, [lv.select("word", "node", "reached") for lv in seen])
            seen = seen.groupBy("word", "node").agg(F.bit_or("reached").alias("seen"))
            ahead = ahead.join(seen, ["word", "node"], "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("bigint")))
        else:
            ahead = ahead.withColumn("seen", F.lit(0).cast("bigint"))
        # A class of one that is the source has nobody else to reach.
        fresh = F.transform("paths", lambda p, i: F.when((F.getbit(F.col("seen"), i) == 0) & (_others(i) > 0), p).otherwise(0.0))
        bits = F.aggregate(
            F.transform("paths", lambda p, i: F.when(p > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))),
            F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
        ahead = ahead.withColumn("paths", fresh).select("word", "node", bits.alias("reached"), "paths", "size", "own").where("reached != 0")
        level = stored(ahead, "level")
        if level.isEmpty():
            forget(level)
            return levels
        levels.append(level)


def _dependencies(levels: list[DataFrame], links: DataFrame, start: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per level, from the last: sums and squares of dependencies by class, what a class depends on by its own source, and
    the table they are read from."""
    out, further = [], None
    times = start.groupBy("word").agg(F.array(*[F.sum(F.when(F.col("place") == i, F.col("times")).otherwise(0.0)) for i in range(WORD)]).alias("times"))
    for level in reversed(levels):
        if further is None:
            carried = level.withColumn("delta", F.transform("paths", lambda p: F.lit(0.0)))
        else:
            given = further.select("word", F.col("node").alias("dst"), F.transform(
                "paths", lambda p, i: F.when(p > 0, _others(i) * (1.0 + F.get("delta", i)) / p).otherwise(0.0)).alias("given"))
            passed = level.select("word", "node").join(links, F.col("node") == F.col("src")).join(given, ["word", "dst"])
            passed = passed.groupBy("word", "node").agg(_array_sum("given").alias("given"))
            delta = F.when(F.col("given").isNull(), F.transform("paths", lambda p: F.lit(0.0))).otherwise(
                F.zip_with("paths", "given", lambda p, g: p * g))
            carried = level.join(passed, ["word", "node"], "left").withColumn("delta", delta).drop("given")
        further = stored(carried.select("word", "node", "paths", "delta", "size", "own"), "carried")
        added = lambda term: F.sum(F.aggregate(F.zip_with("delta", "times", term), F.lit(0.0), lambda a, d: a + d))
        own = F.max(F.when(F.col("own") >= 0, F.get("delta", F.col("own"))))
        out.append((further.join(times, "word").groupBy("node").agg(
            added(lambda d, t: d * t).alias("delta"), added(lambda d, t: d * d * t).alias("square"), own.alias("own")), further))
    return out
