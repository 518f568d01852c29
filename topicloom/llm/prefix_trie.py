"""Prefix trie of conversations from sorted shards and a skeleton of splitter paths.

A conversation is a path of turns. Paths are range-partitioned and sorted, so the members of a trie node are neighbours.
A node whose members lie in several shards holds the first path of a later shard, that is, it is a prefix of a splitter
path; all prefixes of splitter paths are the skeleton, a trie that every task gets by broadcast. Any other node lies in
one shard, which finishes it while it walks its paths with a stack. Of a skeleton node a shard knows a part; the parts
are reduced, and the skeleton is so small that its subtree sums need no further thought. A path that a third of all
conversations share is cut into shards by conversation number, and every shard adds one part per node of it.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from topicloom.llm.common import written

DIGEST, STEP = 16, 20  # bytes of the digest of a turn; of a turn in a path, with the number of its code points
SHARD_BYTES = 8 << 20  # of the paths in a shard
SAMPLE = 32  # paths that are drawn per shard to find splitters
SKELETON_BYTES = 32 << 20  # of splitter paths; with more, every second one goes and shards grow
ENDS = 4096  # conversation numbers in a row of a part
ROWS = 10_000  # rows in a batch

COUNTS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
OUT = ["conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256"]
#: What a shard says: a finished node (``at`` null), or part of skeleton node ``at``. ``below`` is a parent in the skeleton.
FOUND = "at long, below long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard int, chunk int, ends array<long>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path`` of ``conv_id, turn, role, text``: digest and code points of every turn, in order of turns.

    Turns without a number stand first; equal numbers are ordered by the digest of role and text. Null role and text
    are empty. Rows without a conversation belong to none.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    step = F.concat(digest, F.lpad(F.hex(F.length(text)), 8, "0"))
    steps = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", F.unhex(step).alias("step")).alias("s"),
    )
    steps = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return steps.select("conv_id", F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["step"])), "")).alias("path"))


def rebuilt(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Paths in which the first turns come from the conversation whose number is the next multiple of ``every`` below.

    ``crc32`` of the decimal number, modulo ``most``, says how many; all of that conversation's turns if it has fewer,
    none if it does not exist. A conversation's own turns follow after as many of its own.
    """
    heads = own.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.substring("path", 1, (most - 1) * STEP).alias("head")
    )
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most * STEP).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left")
    taken = F.coalesce(F.substring("head", F.lit(1), head), F.lit(bytearray()))
    return joined.select("conv_id", F.concat(taken, F.substring("path", head + 1, F.length("path"))).alias("path"))


def _splitters(members: DataFrame) -> list[tuple[bytes, int]]:
    """Where shards begin, but for the first: every ``SAMPLE``-th of a sample whose size follows the number of shards."""
    total = members.agg(F.sum(F.length("path") + 8)).first()[0] or 0
    shards = max(members.sparkSession.sparkContext.defaultParallelism, math.ceil(total / SHARD_BYTES))
    sample = members.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE * shards).collect()
    starts = sorted((bytes(r["path"]), r["conv_id"]) for r in sample)[SAMPLE::SAMPLE]
    while sum(len(path) for path, _ in starts) > SKELETON_BYTES and len(starts) > 1:
        starts = starts[1::2]
    return starts


def skeleton_of(splitters: list[tuple[bytes, int]]) -> dict[tuple[int, bytes], int]:
    """The trie of splitter paths: number of the node that a step leads to from a node; the root is 0."""
    skeleton: dict[tuple[int, bytes], int] = {}
    for path, _ in splitters:
        at = 0
        for i in range(0, len(path), STEP):
            at = skeleton.setdefault((at, path[i:i + STEP]), len(skeleton) + 1)
    return skeleton


class _Node:
    """An open node of a shard's walk. ``at`` is its number in the skeleton, or None."""

    __slots__ = ("at", "chars", "least", "members", "children", "leaves", "saved", "hash", "ended", "chunk", "waiting")

    def __init__(self, at: int | None, chars: int):
        self.at, self.chars, self.least = at, chars, None
        self.members = self.children = self.leaves = self.saved = self.chunk = 0
        self.hash, self.ended, self.waiting = None, [], []


class Walk:
    """The trie of one shard, from its members in order of path and number. ``rows`` holds what is known by now."""

    def __init__(self, skeleton: dict[tuple[int, bytes], int], shard: int):
        self.skeleton, self.shard, self.rows = skeleton, shard, []
        self.path, self.open = b"", [_Node(0, 0)]

    def add(self, path: bytes, conv_id: int) -> None:
        last, same, end = self.path, 0, min(len(path), len(self.path))
        while same < end and path[same:same + STEP] == last[same:same + STEP]:
            same += STEP
        while len(self.open) > same // STEP + 1:
            self._close()
        for i in range(same, len(path), STEP):
            step, above = path[i:i + STEP], self.open[-1].at
            at = None if above is None else self.skeleton.get((above, step))
            self.open.append(_Node(at, int.from_bytes(step[DIGEST:], "big")))
        self.path, node = path, self.open[-1]
        node.members += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        if node.at is None:
            if node.hash is None:
                node.hash = hashlib.sha256(str(conv_id).encode())
            else:
                node.hash.update(b",%d" % conv_id)
        else:
            node.ended.append(conv_id)
            if len(node.ended) >= ENDS:
                self._ends(node, len(self.open) - 1)

    def _ends(self, node: _Node, depth: int) -> None:
        self.rows.append((node.at, None, None, depth, None, 0, 0, 0, 0, None, self.shard, node.chunk, node.ended))
        node.ended, node.chunk = [], node.chunk + 1

    def _close(self) -> None:
        node, depth = self.open.pop(), len(self.open)
        if node.at is not None:
            if self.open and node.least is not None:
                above = self.open[-1]
                above.members += node.members
                above.least = node.least if above.least is None else min(above.least, node.least)
            if node.least is not None:
                self.rows.append((
                    node.at, None, node.least, depth, None, node.members, node.children, node.leaves, node.saved, None,
                    self.shard, node.chunk, node.ended,
                ))
            return
        above = self.open[-1]
        node.leaves = node.leaves or 1
        node.saved += (node.members - 1) * node.chars
        above.members += node.members
        above.least = node.least if above.least is None else min(above.least, node.least)
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + node.leaves, above.saved + node.saved
        ends = NO_ENDS if node.hash is None else node.hash.hexdigest()
        counts = node.members, node.children, node.leaves, node.saved, ends, None, None, None
        self.rows += [(None, None, r[0], r[1], node.least, *r[2:]) for r in node.waiting]
        if above.at is None:
            above.waiting.append((node.least, depth, *counts))
        else:
            self.rows.append((None, above.at, node.least, depth, None, *counts))

    def end(self) -> None:
        while self.open:
            self._close()


def _combined(parts: DataFrame, skeleton: dict[tuple[int, bytes], int]) -> list[tuple]:
    """``at, below`` and the counts of every skeleton node: its parts summed in Spark, then subtree sums leaf to root."""
    sums = parts.groupBy("at").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in COUNTS]
    )
    nodes = {r["at"]: r.asDict() for r in sums.collect()}  # a row per node of the skeleton, which is broadcast anyway
    above = {to: (of, int.from_bytes(step[DIGEST:], "big")) for (of, step), to in skeleton.items()}
    for at in sorted(nodes, reverse=True):  # a node's number is larger than that of the node above it
        node = nodes[at]
        node["n_leaves"] = node["n_leaves"] or 1
        if at:
            of, chars = above[at]
            node["saved_tokens"] += (node["n_convs"] - 1) * chars
            parent = nodes[of]
            parent["n_children"] += 1
            parent["n_leaves"] += node["n_leaves"]
            parent["saved_tokens"] += node["saved_tokens"]
    return [
        (at, n["conv_id"], n["depth"], nodes[above[at][0]]["conv_id"] if at else None, *[n[c] for c in COUNTS])
        for at, n in nodes.items()
    ]


def _hash_of_ends(parts: DataFrame) -> DataFrame:
    """``at, ends_sha256``: the numbers of a skeleton node, hashed as a stream, however many they are."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = digest = None
        for batch in batches:
            done = []
            for node, ends in zip(batch.column("at").to_pylist(), batch.column("ends")):
                if node != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest, first = node, hashlib.sha256(), True
                text = ",".join(map(str, ends.as_py()))
                digest.update((text if first else "," + text).encode())
                first = False
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["at", "ends_sha256"]
            )
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([digest.hexdigest()])], names=["at", "ends_sha256"])

    ends = parts.where(F.size("ends") > 0).select("at", "shard", "chunk", "ends")
    ordered = ends.repartition("at").sortWithinPartitions("at", "shard", "chunk").select("at", "ends")
    return ordered.mapInArrow(stream, "at long, ends_sha256 string")


def trie_nodes(members: DataFrame) -> DataFrame:
    """A row for every node of the prefix trie of ``conv_id long, path binary``, whose conversation numbers are distinct.

    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id`` that of the node above (null
    for the root), ``n_convs`` and ``n_children`` count members and children, ``n_leaves`` the childless nodes of the
    subtree, ``saved_tokens`` sums members less one times code points over the subtree, and ``ends_sha256`` hashes the
    numbers of the conversations that end at the node. Conversations without turns belong to the root. No member gives
    no row. ``members`` is read three times, so it should be written.
    """
    spark = members.sparkSession
    splitters = _splitters(members)
    skeleton = skeleton_of(splitters)
    shared = spark.sparkContext.broadcast((splitters, skeleton))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value[0]
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            shard = pa.array([bisect_right(starts, key) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("path"), shard], names=["conv_id", "path", "shard"])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*rows), arrow_schema)], schema=arrow_schema
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going = None
        for batch in batches:
            for shard, path, conv_id in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id"))):
                if going is None or going.shard != shard:
                    if going is not None:
                        going.end()
                        if going.rows:
                            yield batch_of(going.rows)
                    going = Walk(shared.value[1], shard)
                going.add(path, conv_id)
                if len(going.rows) >= ROWS:
                    yield batch_of(going.rows)
                    going.rows = []
        if going is not None:
            going.end()
            if going.rows:
                yield batch_of(going.rows)

    found_schema = T.StructType.fromDDL(FOUND)
    arrow_schema = to_arrow_schema(found_schema)
    placed = members.select("conv_id", "path").mapInArrow(place, "conv_id long, path binary, shard int")
    shards = placed.repartitionById(len(splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = written(shards.mapInArrow(walk, found_schema), "trie-nodes")
    parts = found.where("at is not null")
    nodes = spark.createDataFrame(
        _combined(parts, skeleton), "at long, conv_id long, depth long, parent_conv_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    )
    top = nodes.join(_hash_of_ends(parts), "at", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    above = F.broadcast(nodes.select(F.col("at").alias("below"), F.col("conv_id").alias("parent")))
    rest = found.where("at is null").join(above, "below", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent"))
    return rest.select(*OUT).unionByName(top.select(*OUT))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """``trie_nodes`` of the rebuilt conversations of ``conv_id, turn, role, text``.

    Null role and text are empty, null turns stand first, turns of equal number in the order of a digest of role and
    text. Rows without ``conv_id`` are no conversation. Other columns are not read. An empty table gives no node.
    A task holds whole paths, 20 bytes a turn, and never a text.
    """
    own = paths(turns.select("conv_id", "turn", "role", "text"))
    return trie_nodes(written(rebuilt(written(own, "paths")), "rebuilt-paths"))
