"""PageRank."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import forget, free_shuffles, stored

EDGES_PER_SALT = 4_000_000  # of one block in one place
PLACE = 33  # bits of a number below its block
IN_BLOCK = (1 << PLACE) - 1

PLACES = "block long, nodes long, sinks long, share binary, salts long"
CHUNKS = "block long, salt long, edges long, reached long, src binary, times binary, ends binary"
PARTS = "block long, places binary, sums binary"
STATE = "block long, salts long, rank binary, sent binary, lost double, left double"


def numbered_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``id``, stored: the block of a row in the upper bits, its place there in the lower 33."""
    n = rows.count()
    blocks = max(1, min(48, -(-n // 50_000)), -(-n // 2_000_000))
    return stored(rows.repartition(blocks).withColumn("id", F.monotonically_increasing_id()), "numbered")


def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iters: int = 20, cut_every: int = 2, numbered: bool = False
) -> DataFrame:
    """``id, rank`` after ``iters`` rounds, the ranks adding up to 1.

    ``nodes`` has column ``id``, ``edges`` has ``src, dst`` with both ends among the nodes.
    The rank of a sink, a node without outgoing edges, is spread over all nodes. ``numbered`` says
    that ids are those of ``numbered_rows`` already, and both tables stored.
    """
    # Rounds run on numbers instead of names; what is stored fixes which number a node has.
    if numbered:
        named, links = nodes.select(F.col("id").alias("name"), "id"), edges.select("src", "dst")
    else:
        named = numbered_rows(nodes.select(F.col("id").alias("name")).distinct())
        links = stored(edges.select("src", "dst").join(
            named.select(F.col("name").alias("src"), F.col("id").alias("a")), "src").join(
            named.select(F.col("name").alias("dst"), F.col("id").alias("b")), "dst"
        ).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")
    places = stored(_places(named, links), "places")
    n, n_sinks = places.agg(F.sum("nodes"), F.sum("sinks")).first()
    if not n:
        return named.select(F.col("name").alias("id"), F.lit(0.0).alias("rank"))
    if not iters:
        return named.select(F.col("name").alias("id"), F.lit(1.0 / n).alias("rank"))
    # Edges are dealt by the block of their source and a salt, packed, and kept on disk in a form whose partitioning and
    # order the plan knows: a round moves ranks and sums, never edges. A lost part is made again from the stored table.
    packed = stored(_packed(links, places), "chunks")
    free_shuffles(nodes.sparkSession)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = packed.repartition(parts, "block", "salt").sortWithinPartitions("block", "salt").persist(StorageLevel.DISK_ONLY)
    ones = places.select("block", "salts", F.col("share").alias("sent"))
    first = stored(_passed_on(ones, chunks, places, 0.0, 1.0), "power") if n_sinks else None
    if first is None or not first.agg(F.sum("lost")).first()[0]:
        ranks = _with_lone_sinks(ones, n, chunks, places, n_sinks, damping, iters, cut_every)
    else:
        ranks = _with_reached_sinks(first, n, chunks, places, damping, iters)
    ranks = stored(ranks.mapInArrow(_rows_of_blocks, "id long, rank double"), "ranks")
    chunks.unpersist()
    forget(packed)
    return named.join(ranks, "id").select(F.col("name").alias("id"), "rank")


def _block(number: str):
    return F.shiftright(number, PLACE)


def _places(named: DataFrame, links: DataFrame) -> DataFrame:
    """Per block its number of nodes and of sinks, what share of a node's rank goes along each of its edges (0 for a
    sink), and over how many salts its edges are dealt."""
    nodes = named.groupBy(_block("id").alias("block")).agg(F.count("*").alias("nodes"))
    out = links.groupBy("src").agg(F.count("*").alias("out")).select(_block("src").alias("block"), "src", "out")

    def shares(out: pa.Table, nodes: pa.Table) -> pa.Table:
        size, share = nodes["nodes"][0].as_py(), None
        counts = out["out"].to_numpy()
        share = np.zeros(size)
        share[out["src"].to_numpy() & IN_BLOCK] = 1.0 / counts
        salts = max(1, -(-int(counts.sum()) // EDGES_PER_SALT))
        return pa.table({
            "block": nodes["block"].slice(0, 1), "nodes": pa.array([size]), "sinks": pa.array([size - len(counts)]),
            "share": pa.array([share.tobytes()], pa.binary()), "salts": pa.array([salts]),
        })

    return out.groupBy("block").cogroup(nodes.groupBy("block")).applyInArrow(shares, PLACES)


def _packed(links: DataFrame, places: DataFrame) -> DataFrame:
    """One row for the edges of a block and salt, in order of their ends: the ends, how many edges lead to each, and places
    of the sources; as steps, compressed, since a row lies on disk several times.

    The salt goes by the end of an edge, so the edges of a heavy source lie in several rows, and what goes from a block
    to one end is added up in one place.
    """
    salted = links.withColumn("block", _block("src")).join(F.broadcast(places.select("block", "salts")), "block").select(
        "block", F.pmod(F.xxhash64("dst"), "salts").alias("salt"), "src", "dst")

    def pack(edges: pa.Table) -> pa.Table:
        src, dst = edges["src"].to_numpy() & IN_BLOCK, edges["dst"].to_numpy()
        order = np.lexsort((src, dst))
        ends, times = np.unique(dst, return_counts=True)
        binary = lambda a: pa.array([pa.compress(a, codec="zstd", asbytes=True)], pa.binary())
        return pa.table({
            "block": edges["block"].slice(0, 1), "salt": edges["salt"].slice(0, 1), "edges": pa.array([len(src)]), "reached": pa.array([len(ends)]),
            "src": binary(np.diff(src[order], prepend=0).astype(np.int32)), "times": binary(times.astype(np.int32)),
            "ends": binary(np.diff(ends, prepend=0)),
        })

    return salted.groupBy("block", "salt").applyInArrow(pack, CHUNKS)


def _passed_on(state: DataFrame, chunks: DataFrame, places: DataFrame, base: float, scale: float) -> DataFrame:
    """The next state: ``base`` plus ``scale`` times what nodes receive. ``lost`` is what the sinks of a block hold,
    ``left`` tells whether its other nodes hold anything."""
    sent = state.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "sent")

    def send(chunk: pa.Table, sent: pa.Table) -> pa.Table:
        blocks, places, sums = [], [], []
        if chunk.num_rows:
            n, k = chunk["edges"][0].as_py(), chunk["reached"][0].as_py()
            unpack = lambda c, size, kind: np.frombuffer(
                pa.decompress(chunk[c][0].as_py(), decompressed_size=size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)
            src, ends = np.cumsum(unpack("src", n, np.int32), dtype=np.int32), np.cumsum(unpack("ends", k, np.int64))
            at = np.repeat(np.arange(k, dtype=np.int32), unpack("times", k, np.int32))
            added = np.bincount(at, np.frombuffer(sent["sent"][0].as_py())[src], len(ends))
            cuts = np.flatnonzero(np.diff(ends >> PLACE)) + 1
            for e, s in zip(np.split(ends, cuts), np.split(added, cuts)):
                blocks.append(int(e[0] >> PLACE))
                places.append(np.diff(e & IN_BLOCK, prepend=0).astype(np.int32).tobytes())  # steps compress well
                sums.append(s.tobytes())
        return pa.table({"block": pa.array(blocks, pa.int64()), "places": pa.array(places, pa.binary()), "sums": pa.array(sums, pa.binary())})

    def receive(place: pa.Table, parts: pa.Table) -> pa.Table:
        share = np.frombuffer(place["share"][0].as_py())
        rank = np.zeros(len(share))
        for at, sums in zip(parts["places"], parts["sums"]):
            rank[np.cumsum(np.frombuffer(at.as_py(), np.int32))] += np.frombuffer(sums.as_py())  # each place once in a part
        rank = base + scale * rank
        return pa.table({
            "block": place["block"], "salts": place["salts"], "rank": pa.array([rank.tobytes()], pa.binary()),
            "sent": pa.array([(rank * share).tobytes()], pa.binary()), "lost": pa.array([float(rank[share == 0].sum())]),
            "left": pa.array([float((rank * share).sum())]),
        })

    sums = chunks.groupBy("block", "salt").cogroup(sent.groupBy("block", "salt")).applyInArrow(send, PARTS)
    at = places.select("block", "share", "salts")
    return at.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(receive, STATE)


def _rows_of_blocks(batches):
    for batch in batches:
        for block, rank in zip(batch["block"], batch["rank"]):
            rank = np.frombuffer(rank.as_py())
            ids = np.arange(len(rank), dtype=np.int64) + (block.as_py() << PLACE)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rank)], ["id", "rank"])


def _with_lone_sinks(
    ones: DataFrame, n: int, chunks: DataFrame, places: DataFrame, n_sinks: int, damping: float, iters: int, cut_every: int
) -> DataFrame:
    """Nothing points at a sink, as in an undirected graph: all sinks share one known rank."""
    state, alone, scale, before = ones, 1.0 / n, damping / n, None
    for i in range(1, iters + 1):
        alone = (1 - damping) / n + damping * n_sinks * alone / n
        state, scale = _passed_on(state, chunks, places, alone, scale), damping
        if i % cut_every == 0 and i < iters:
            state = stored(state, "ranks")
            forget(*([before] if before is not None else []))
            free_shuffles(state.sparkSession)  # else the sums of all rounds stay on disk together
            before = state
    return state.select("block", "rank")


def _with_reached_sinks(first: DataFrame, n: int, chunks: DataFrame, places: DataFrame, damping: float, iters: int) -> DataFrame:
    """The general case, without asking for the rank of the sinks in every round.

    With P passing ranks along the edges, round t gives r(t) = a(t) + damping * P r(t - 1), where
    a(t) is the same for all nodes. So r(t) is the sum over j of a(t - j) * damping^j * P^j 1. The
    powers P^j 1 need no a(t); they end early when no path is that long. Their sums over the
    sinks then give all a(t), one after the other.
    """
    sinks = places.agg(F.sum("sinks")).first()[0]
    powers, lost = [first], {0: float(sinks), 1: first.agg(F.sum("lost")).first()[0]}
    for j in range(2, iters + 1):
        power = stored(_passed_on(powers[-1], chunks, places, 0.0, 1.0), "power")
        free_shuffles(power.sparkSession)
        lost[j], left = power.agg(F.sum("lost"), F.sum("left")).first()
        powers.append(power)
        if not left:  # all of it lies in sinks, so the next power is 0
            break
    even = [1.0 / n]
    for t in range(iters):
        mass = sum(even[t - j] * damping**j * lost.get(j, 0.0) for j in range(t + 1))
        even.append((1 - damping) / n + damping * mass / n)
    steps = reduce(DataFrame.unionByName, [
        p.select("block", "rank", F.lit(even[iters - j] * damping**j).alias("times")) for j, p in enumerate(powers, 1)
    ])
    alone = even[iters]

    def add(rows: pa.Table) -> pa.Table:
        rank = alone
        for part, times in zip(rows["rank"], rows["times"]):
            rank = rank + times.as_py() * np.frombuffer(part.as_py())
        return pa.table({"block": rows["block"].slice(0, 1), "rank": pa.array([rank.tobytes()], pa.binary())})

    return steps.groupBy("block").applyInArrow(add, "block long, rank binary")
