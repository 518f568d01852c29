"""Cosine top-k linking of entities to topics: cells of topics with centre and radius, pruned by the angle to them."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.constants import LINKS_PER_ENTITY, POST_THRESHOLD
from topicloom.operators.topk import top_k_per_key
from topicloom.runtime import stored

TASK_NUMBERS = 2_000_000  # of the vectors of either side that a task holds at once: 16 MB
MOST_CELLS = 512  # of topics; their centres are all that every task gets
SAMPLE = 16 * MOST_CELLS  # topic vectors at most that the centres are fitted on, in the driver
SLACK = 1e-7  # on cosines, against rounding


class Cells(NamedTuple):
    """Cells of topic vectors: unit centres, the largest angle of a member, and the blocks that hold a cell."""

    centres: np.ndarray
    radii: np.ndarray
    blocks: list[list[int]]


def misfits(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """The rows that can't be linked: without a vector, or with one of another length than ``dim``."""
    return df.where(F.col(vector).isNull() | (F.size(vector) != dim))


def _unit(vectors) -> np.ndarray:
    """Rows of length 1; a vector of length 0, or with a number that is not finite, becomes nan and matches nothing."""
    m = np.asarray(vectors, dtype="float64")
    with np.errstate(invalid="ignore", over="ignore"):
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norms, out=np.full_like(m, np.nan), where=(norms > 0) & np.isfinite(norms))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)


def _fitted_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` unit centres: far apart from one another at first, then means of the nearest vectors."""
    sample = sample[~np.isnan(sample).any(axis=1)]
    if not len(sample):
        return sample
    chosen, best = [0], sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, sample @ sample[chosen[-1]])
    centres = sample[chosen]
    for _ in range(4):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        means = _unit(sums)
        centres = np.where(np.isnan(means), centres, means)
    return centres


def _upper_bounds(left: np.ndarray, cells: Cells) -> np.ndarray:
    """The largest cosine that a row of ``left`` can have with a member of a cell, by the triangle of angles."""
    apart = np.arccos(np.clip(left @ cells.centres.T, -1, 1)) - cells.radii
    return np.cos(np.maximum(apart, 0)) + SLACK


class _Best:
    """The best ``k`` topics of rows, a topic once at its best, equal similarities in name order."""

    def __init__(self, rows: int, k: int, threshold: float, floors: np.ndarray):
        self.k, self.floors, self.parts, self.held = k, np.maximum(floors, threshold), [], 0
        self.most = max(200_000, 4 * rows * k)

    def add(self, rows: np.ndarray, codes: np.ndarray, sims: np.ndarray) -> None:
        self.parts.append((rows, codes, sims))
        self.held += len(rows)
        if self.held > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        rows, codes, sims = (np.concatenate(part) for part in zip(*self.parts))
        order = np.lexsort((-sims, codes, rows))
        rows, codes, sims = rows[order], codes[order], sims[order]
        once = np.ones(len(rows), bool)
        once[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
        rows, codes, sims = rows[once], codes[once], sims[once]
        order = np.lexsort((codes, -sims, rows))
        rows, codes, sims = rows[order], codes[order], sims[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == self.k - 1
        self.floors[rows[last]] = np.maximum(self.floors[rows[last]], sims[last])
        keep = place < self.k
        self.parts = [(rows[keep], codes[keep], sims[keep])]
        self.held = int(keep.sum())
        return self.parts[0]


def _links(left, right, codes, of_cell, cells: Cells, threshold: float, k: int, floors, compared) -> _Best:
    """Rows of ``left`` meet the cells of ``right``: first the nearest one each, then those whose bound is not beaten.

    ``right`` is sorted by cell and by topic ``codes`` within it. ``floors`` is what a link must reach to count.
    """
    best = _Best(len(left), k, threshold, floors)
    if not len(right):
        return best
    present, starts = np.unique(of_cell, return_index=True)
    ends = np.append(starts[1:], len(of_cell))
    step = max(1, 2_000_000 // max(1, int((ends - starts).max(initial=1))))
    bounds = _upper_bounds(left, Cells(cells.centres[present], cells.radii[present], []))
    nearest = bounds.argmax(axis=1)

    def meet(c: int, rows: np.ndarray) -> None:
        members, names = right[starts[c]:ends[c]], codes[starts[c]:ends[c]]
        firsts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            sims = np.maximum.reduceat(left[some] @ members.T, firsts, axis=1)
            r, t = np.nonzero(sims >= best.floors[some][:, None])
            best.add(some[r], names[firsts][t], sims[r, t])
            if compared is not None:
                compared.add(len(some) * len(members))

    for c in range(len(present)):
        meet(c, np.flatnonzero(nearest == c))
    best.settle()
    for c in np.argsort(-bounds.mean(axis=0), kind="stable"):
        meet(c, np.flatnonzero((nearest != c) & (bounds[:, c] >= best.floors)))
    best.settle()
    return best


def link_topics(
    entities: DataFrame,
    topics: DataFrame,
    key: str = "id",
    topic: str = "topic",
    vector: str = "embedding",
    threshold: float = POST_THRESHOLD,
    k: int = LINKS_PER_ENTITY,
    dim: int = 384,
    max_topics: int | None = None,
    compared: Accumulator | None = None,
) -> DataFrame:
    """The best ``k`` topics per entity with cosine similarity of at least ``threshold``, exactly.

    Vectors are taken whole and must have ``dim`` numbers; ``misfits`` returns the rows that have not. Topic vectors fall
    into cells, each with a centre and the angle of its farthest member, and cells are packed into blocks of at most
    ``max_topics`` vectors (by default 16 MB of them). An entity meets the block of the cell that may hold its nearest
    topic, and after it only blocks with a cell that can still beat its ``k``-th best topic, or reach the threshold; in
    a block it meets only such cells. ``compared``, if given, adds up the pairs of vectors that were multiplied.

    Only a sample of at most ``SAMPLE`` topic vectors passes through the driver, where centres are fitted; they decide what
    is skipped, and not the result. Vectors of either side are computed once, and written before they are read again.
    Repeated keys share their slots: a topic counts once, at its best.
    """
    bound = max(1, max_topics if max_topics is not None else TASK_NUMBERS // dim)
    names = topics.where(F.col(topic).isNotNull()).select(
        F.col(topic).cast("string").alias("topic"), F.col(vector).cast("array<double>").alias("v"))
    left = entities.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    fit = (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull())
    # Equal rows of either side make equal links; without them no hash is hot, and only distinct vectors are written.
    names, left = (stored(side.where(fit).distinct(), "vectors") for side in (names, left))
    names, cells = _in_cells(names, dim, bound)
    key_type = left.schema["key"].dataType.simpleString()
    found = "key {0}, v array<double>, home int, floor double, links array<struct<topic string, cosine_similarity double>>".format(key_type)

    def at_home(batches):
        for batch in batches:
            unit = _unit(_matrix(batch.column("v"), dim))
            good = ~np.isnan(unit).any(axis=1)
            batch, unit = batch.filter(pa.array(good)), unit[good]
            if batch.num_rows and len(cells.centres):
                bounds = _upper_bounds(unit, cells)
                homes = np.array([b[0] for b in cells.blocks])[bounds.argmax(axis=1)]
                none = pa.array([threshold] * len(homes), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(homes, pa.int32()), none], ["key", "v", "block", "floor"])

    def elsewhere(batches):
        for batch in batches:
            bounds = _upper_bounds(_unit(_matrix(batch.column("v"), dim)), cells)
            floor, home = (batch.column(c).to_numpy() for c in ("floor", "home"))
            blocks = 1 + max(b for of in cells.blocks for b in of)
            best = np.full((len(floor), blocks), -2.0)
            for c, of in enumerate(cells.blocks):
                best[:, of] = np.maximum(best[:, of], bounds[:, [c]])
            best[np.arange(len(home)), home] = -2.0
            rows, to = np.nonzero(best >= floor[:, None])
            if len(rows):
                moved = batch.select(["key", "v", "floor"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([moved["key"], moved["v"], pa.array(to, pa.int32()), moved["floor"]], ["key", "v", "block", "floor"])

    visit = f"key {key_type}, v array<double>, block int, floor double"
    first = stored(_visits(left.mapInArrow(at_home, visit), names, cells, threshold, k, dim, found, compared), "links-at-home")
    links = first
    if max((b for of in cells.blocks for b in of), default=0) > 0:
        moved = first.select("key", "v", "home", "floor").mapInArrow(elsewhere, visit)
        links = first.unionByName(_visits(moved, names, cells, threshold, k, dim, found, compared))
    best = links.select("key", F.inline("links")).groupBy("key", "topic").agg(F.max("cosine_similarity").alias("cosine_similarity"))
    ranked = top_k_per_key(best, "key", [F.desc("cosine_similarity"), "topic"], k)
    return ranked.select(F.col("key").alias(key), "topic", "cosine_similarity", "rank")


def _in_cells(names: DataFrame, dim: int, bound: int) -> tuple[DataFrame, Cells]:
    """``topic, v, cell, block`` of topic vectors with a direction, and their cells."""
    count = names.count()
    wanted = min(MOST_CELLS, max(1, math.isqrt(count)))
    sample = names.select("v", F.xxhash64("topic", "v").alias("draw")).orderBy("draw").limit(min(SAMPLE, 16 * wanted)).select("v")
    centres = _fitted_centres(_unit(_matrix(sample.toArrow()["v"], dim)), wanted)

    def nearest(batches):
        for batch in batches:
            unit = _unit(_matrix(batch.column("v"), dim))
            good = ~np.isnan(unit).any(axis=1)
            batch, unit = batch.filter(pa.array(good)), unit[good]
            if batch.num_rows:
                sims = unit @ centres.T
                cell = sims.argmax(axis=1)
                apart = np.arccos(np.clip(sims[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(apart)], ["topic", "v", "cell", "apart"])

    shape = "topic string, v array<double>, cell int, apart double"
    if not len(centres):
        empty = names.limit(0).selectExpr("topic", "v", "0 AS cell", "0 AS block")
        return empty, Cells(centres, np.empty(0), [])
    placed = stored(names.mapInArrow(nearest, shape), "topic-cells")
    sizes = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect()}
    # Cells without members are gone. Neighbours stand together in blocks; a cell beyond the bound has blocks of its own.
    order, block, room, blocks, rest = [], 0, bound, {}, sorted(sizes)
    while rest:
        near = max(rest, key=lambda c: centres[c] @ centres[order[-1]]) if order else rest[0]
        rest.remove(near)
        order.append(near)
        parts = math.ceil(sizes[near].n / bound)
        if parts > 1 or sizes[near].n > room:
            block += room < bound
            room = bound
        blocks[near] = list(range(block, block + parts))
        if parts > 1:
            block, room = block + parts, bound
        else:
            room -= sizes[near].n
    number = {c: i for i, c in enumerate(order)}
    place = placed.sparkSession.createDataFrame([(c, number[c], blocks[c][0], len(blocks[c])) for c in order], "cell int, number int, first int, parts int")
    part = F.pmod(F.xxhash64("topic", "v"), F.col("parts")).cast("int")
    names = placed.join(F.broadcast(place), "cell").select("topic", "v", F.col("number").alias("cell"), (F.col("first") + part).alias("block"))
    return names, Cells(centres[order], np.array([sizes[c].radius for c in order]) + SLACK, [blocks[c] for c in order])


def _visits(
    visits: DataFrame, names: DataFrame, cells: Cells, threshold: float, k: int, dim: int, schema: str, compared: Accumulator | None,
) -> DataFrame:
    """The best links of every visiting row in the block that it visits, and what its ``k``-th best reaches."""
    rows_of_task = max(1, TASK_NUMBERS // dim)
    visits = stored(visits, "visits")
    tasks = 2 * visits.sparkSession.sparkContext.defaultParallelism
    counted = visits.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    total = visits.count()
    # A block has a part for as many rows as a task holds, or for an even share of all rows if that is less.
    share = max(1, min(rows_of_task, math.ceil(total / tasks)))
    parts = counted.select("block", F.ceil(F.col("n") / share).cast("int").alias("parts"))
    mine = visits.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("key", "v"), F.col("parts")).cast("int")).drop("parts")
    theirs = names.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def link(mine, others):
        fields = mine.schema
        if not mine.num_rows:
            return pa.table([pa.array([], fields.field("key").type), pa.array([], pa.list_(pa.float64())), pa.array([], pa.int32()),
                             pa.array([], pa.float64()), pa.array([], LINKS)], names=OUT)
        others = others.sort_by([("cell", "ascending"), ("topic", "ascending")])
        known, codes = np.unique(others["topic"].to_numpy(), return_inverse=True)
        best = _links(
            _unit(_matrix(mine["v"], dim)), _unit(_matrix(others["v"], dim)), codes, others["cell"].to_numpy(), cells, threshold, k,
            mine["floor"].to_numpy().copy(), compared)
        rows, codes, sims = best.settle()
        offsets = np.searchsorted(rows, np.arange(mine.num_rows + 1)).astype("int32")
        pairs = pa.StructArray.from_arrays([pa.array(known[codes], pa.string()), pa.array(sims, pa.float64())], names=["topic", "cosine_similarity"])
        lists = pa.ListArray.from_arrays(pa.array(offsets), pairs)
        return pa.table([mine["key"], mine["v"], mine["block"], pa.array(best.floors), lists], names=OUT)

    pairs = mine.groupBy("block", "part").cogroup(theirs.groupBy("block", "part"))
    return pairs.applyInArrow(link, schema)


OUT = ["key", "v", "home", "floor", "links"]
LINKS = pa.list_(pa.struct([("topic", pa.string()), ("cosine_similarity", pa.float64())]))
