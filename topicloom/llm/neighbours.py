"""Approximate nearest neighbours by balanced posting lists.

Centroids are the leaves of repeated two-means splits of a sample, so lists hold about equally many vectors. A vector
near a boundary is entered in the lists of all centroids that are about as near as the nearest. Centroids are searched
by a best-first walk on their neighbour graph, held in memory. A query reads the lists of centroids within a ratio of
its nearest one's distance. Long lists are dealt in blocks to several tasks. Distances are exact and in double
precision; only which lists are read is approximate.

Of equal vectors only the ``k + 1`` smallest ids can be among any result, so a vector is indexed once with those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import written

SAMPLE = 20_000  # distinct vectors on which centroids are fitted, drawn by hash
LIST = 128  # vectors of the index that a list should hold, as far as the sample allows
LEAST_SAMPLE = 16  # vectors of the sample for each centroid
BLOCK = 4096  # entries of a list that go to one task
DEGREE = 24  # of the graph


def split_centroids(x: np.ndarray, most: int) -> np.ndarray:
    """Means of the leaves when clusters of over ``most`` rows are split in two, over and over, into near halves."""
    leaves, open_ = [], [np.arange(len(x))]
    draw = np.random.default_rng(7)
    while open_:
        rows = open_.pop()
        part = x[rows]
        if len(rows) <= most:
            leaves.append(part.mean(0))
            continue
        a, b = part[draw.choice(len(rows), 2, replace=False)]
        for _ in range(8):
            lean = ((part - a) ** 2).sum(1) - ((part - b) ** 2).sum(1)
            # The cut lies where two-means puts it, but each side gets three tenths of the rows at least.
            low, high = np.quantile(lean, [0.3, 0.7])
            side = lean <= min(max(0.0, low), high)
            if side.all() or not side.any():
                side = np.arange(len(rows)) < len(rows) // 2
            a, b = part[side].mean(0), part[~side].mean(0)
        open_ += [rows[side], rows[~side]]
    return np.array(leaves)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)


class CentroidGraph:
    """Each centroid linked with its nearest ones and with some far ones, so that every walk can get anywhere."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        count = len(centroids)
        near = np.empty((count, min(DEGREE, count - 1)), np.int64)
        for start in range(0, count, 512):
            d = distances(centroids[start:start + 512], centroids)
            d[np.arange(len(d)), np.arange(start, start + len(d))] = np.inf
            near[start:start + 512] = np.argsort(d, axis=1, kind="stable")[:, :near.shape[1]]
        far = (np.arange(count)[:, None] + np.array([1, 7, 31, 131, 523])) % max(1, count)
        self.links = np.hstack([near, far])
        self.entry = np.unique(np.linspace(0, count - 1, min(count, 16)).astype(int))

    def nearest(self, x: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk for a batch of vectors: ids and squared distances of up to ``breadth`` centroids, nearest first."""
        count, breadth = len(x), min(breadth, len(self.centroids))
        seen = np.zeros((count, len(self.centroids)), bool)
        seen[:, self.entry] = True
        ids = np.tile(self.entry, (count, 1))
        d = distances(x, self.centroids[self.entry])
        done = np.zeros_like(d, bool)
        rows = np.arange(count)
        if ids.shape[1] < breadth:
            more = ((0, 0), (0, breadth - ids.shape[1]))
            ids, d, done = np.pad(ids, more), np.pad(d, more, constant_values=np.inf), np.pad(done, more, constant_values=True)
        while True:
            waiting = np.where(done, np.inf, d)
            best = waiting.argmin(1)
            if not np.isfinite(waiting[rows, best]).any():
                break
            done[rows, best] = True
            new = self.links[ids[rows, best]]
            known = seen[rows[:, None], new] | ~np.isfinite(waiting[rows, best])[:, None]
            # The same link twice in a row counts once.
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, 1)
            twice = np.zeros_like(known)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            known |= twice
            seen[rows[:, None], new] = True
            gap = x[:, None, :] - self.centroids[new]
            new_d = np.where(known, np.inf, np.einsum("nkd,nkd->nk", gap, gap))
            ids, d, done = np.hstack([ids, new]), np.hstack([d, new_d]), np.hstack([done, known])
            keep = np.argsort(d, axis=1, kind="stable")[:, :breadth]
            ids, d, done = (np.take_along_axis(v, keep, 1) for v in (ids, d, done))
        return ids, d


def _lists_of(graph: CentroidGraph, x: np.ndarray, breadth: int, ratio: float, most: int | None, least: int) -> Iterator[np.ndarray]:
    """For each vector the lists whose centroid is within ``ratio`` of the nearest one's distance."""
    for start in range(0, len(x), 1024):
        ids, d = graph.nearest(x[start:start + 1024], breadth)
        within = (d <= d[:, :1] * ratio**2) & np.isfinite(d)
        within[:, :least] |= np.isfinite(d[:, :least])
        if most is not None:
            within[:, most:] = False
        for row, keep in zip(ids, within):
            yield row[keep]


def _packed(df: DataFrame, id_col: str, vector_col: str, dim: int | None) -> DataFrame:
    """``vec_id, v``: the components as packed doubles, without vectors that take no part."""
    source = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    source = source.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    source = source.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    source = source.where(F.exists("v", lambda c: c != 0))
    if dim is not None:
        source = source.where(F.size("v") == dim)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [(np.array(v) + 0.0).astype("<f8").tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    return source.mapInArrow(pack, "vec_id bigint, v binary")


def nearest_neighbours(
    vectors: DataFrame, query_every: int, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    breadth: int = 96, ratio: float = 1.3, copies: int = 6, copy_ratio: float = 1.06, least_lists: int = 32,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``query_every`` its ``k`` nearest others.

    ``score`` is the Euclidean distance in double precision, ties go to the smaller id. Vectors that are null or zero,
    hold a null or a number that isn't finite, or have no id take no part, nor do those of another length than most;
    an empty table gives no rows. Rows that repeat an id and vector are one. Other columns are not read. A query reads
    lists up to ``ratio`` times its nearest centroid's distance, ``least_lists`` at least, of the ``breadth`` nearest.
    The centroids are fitted on at most ``SAMPLE`` vectors; all vectors are indexed.
    """
    usual = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("n")).count()
    usual = usual.orderBy(F.desc("count"), "n").first()
    packed = _packed(vectors, id_col, vector_col, usual["n"] if usual else 0).distinct()
    of_equal = Window.partitionBy("v").orderBy("vec_id")
    first = packed.withColumn("r", F.row_number().over(of_equal)).where(F.col("r") <= k + 1)
    distinct = written(first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")

    count = distinct.count()
    drawn = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    shape = (-1, usual["n"] if usual and usual["n"] else 1)
    sample = np.frombuffer(b"".join(r["v"] for r in drawn), "<f8").reshape(shape)
    leaf = max(LEAST_SAMPLE, LIST * len(sample) // max(1, count))
    centroids = split_centroids(sample, leaf) if len(sample) else np.zeros((1, shape[1]))
    held = vectors.sparkSession.sparkContext.broadcast(centroids)  # at most SAMPLE / LEAST_SAMPLE rows

    def enter(reach: int, near: float, most: int | None, least: int, names: list[str]):
        def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = None
            for batch in batches:
                graph = graph or CentroidGraph(held.value)
                x = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<f8").reshape(shape)
                lists = list(_lists_of(graph, x, reach, near, most, least))
                rows = batch.take(pa.array(np.repeat(np.arange(len(lists)), [len(v) for v in lists])))
                flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), *(rows.column(n) for n in names)], names=["list", *names])

        return entered

    postings = written(
        distinct.mapInArrow(enter(16, copy_ratio, copies, 1, ["v", "ids"]), "list bigint, v binary, ids array<bigint>"), "postings"
    )
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # a row per centroid
    blocks = {number: -(-size // BLOCK) for number, size in sizes.items()}
    many = F.create_map(*[F.lit(v) for number, n in blocks.items() if n > 1 for v in (number, n)]) if any(n > 1 for n in blocks.values()) else None
    parts = F.coalesce(many[F.col("list")], F.lit(1)) if many is not None else F.lit(1)
    postings = postings.withColumn("block", F.pmod(F.xxhash64("v"), parts).cast("int"))

    queries = packed.where(F.col("vec_id") % query_every == 0)
    asked = queries.select("v").distinct().mapInArrow(enter(breadth, ratio, None, least_lists, ["v"]), "list bigint, v binary")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))

    def search(table_q: pa.Table, table_p: pa.Table) -> pa.Table:
        q = np.frombuffer(b"".join(table_q["v"].to_pylist()), "<f8").reshape(shape)
        p = np.frombuffer(b"".join(table_p["v"].to_pylist()), "<f8").reshape(shape)
        ids = table_p["ids"].to_pylist()
        out_v, out_d, out_ids = [], [], []
        if len(q) and len(p):
            smallest = np.array([i[0] for i in ids])
            keys = table_q["v"].to_pylist()
            for start in range(0, len(q), 16):
                part = q[start:start + 16]
                d = np.sqrt(((part[:, None, :] - p) ** 2).sum(-1))
                for row, of_row in enumerate(d):
                    best = np.lexsort((smallest, of_row))[:k + 1]
                    out_v += [keys[start + row]] * len(best)
                    out_d += of_row[best].tolist()
                    out_ids += [ids[i] for i in best]
        return pa.table([pa.array(out_v, pa.binary()), pa.array(out_d, pa.float64()), pa.array(out_ids, pa.list_(pa.int64()))], names=["v", "score", "ids"])

    met = asked.groupBy("list", "block").cogroup(postings.groupBy("list", "block")).applyInArrow(
        search, "v binary, score double, ids array<bigint>"
    )
    hits = met.select("v", "score", F.explode("ids").alias("vec_id")).distinct()
    nearest = Window.partitionBy("v").orderBy("score", "vec_id")
    hits = hits.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
    hits = hits.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("hits"))
    own = queries.select(F.col("vec_id").alias("query_id"), "v").join(hits, "v")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others)).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score")
    )
