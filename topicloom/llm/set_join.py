"""Size-aware heavy-light join of shingle sets by Jaccard similarity, down to connected classes.

Light (small) sets list their subsets of fixed sizes: if two sets are alike enough, what they share is a subset of
both that lacks at most ``size * (1 - similarity)`` elements, so enumerating those subsets lets them meet at an equal
key. Heavy (large) sets are entered in inverted lists. A list is kept per hash range of a set, not per shingle: with
one more range than elements may differ, some range is equal in both sets, and its key is the sum of its elements, so a
frequent shingle does not make a long list. There are some ranges more than that, and as many of its most frequent keys
are left out of a set: like sets still share a key, and sets that share a phrase mostly don't. The boundary is the size at which the keys of all sets cost least.

A list is first reduced to a star: everything in it is compared with its smallest member only, its hub, and what that
connects needs no comparison any more. The members of a hub that are still in different classes are then tried by their
outlines, and those that may be like another are compared in blocks of bounded size, by products of incidence matrices;
a block gives back which of its sets are connected, not the pairs. So a group of thousands of near copies makes a few rows per copy, and no link between classes
is lost. Every comparison is exact and on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.graph.components import connected_components
from topicloom.llm.common import ascii_words, discard, gram_hashes, id_and_text, mix, slices, word_hashes, written
from topicloom.runtime import has_at_most

MOST_LACKING = 2  # elements that a subset of a light set may lack; with more there are too many subsets
LIST_WEIGHT = 4  # cost of an entry of an inverted list, in subsets: it is met by chance more often
OUTLINE = 256  # counts at least by which a pair is tried before whole sets are compared; larger sets have more
OUTLINES = 1000  # that one side of a block holds
BLOCK = 200_000  # elements of the sets that one side of a block holds
SETS = 400  # that one side of a block holds
COLUMNS = 1024  # of an incidence matrix at once
KIND = np.uint64(3)  # last bits of a key: parity of the band of a range, or all of them for a subset
FEW_KEYS = 2_000_000  # shared keys that are broadcast, some 100 MB; beyond that they are joined
FEW_IDS = 500_000  # candidate ids that are broadcast; beyond that they are joined


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of ``n`` words in a row; of the whole text if it has fewer words; none without words."""
    words = word_hashes(ascii_words(text, lower=True))
    if not len(words):
        return words
    return np.unique(gram_hashes(words, n) if len(words) >= n else mix(gram_hashes(words, len(words)) + np.uint64(len(words))))


def size_bands(upto: int) -> list[int]:
    """Lower ends of the size bands, each half as large again as the one before."""
    lows = [1]
    while lows[-1] <= upto:
        lows.append(max(lows[-1] + 1, lows[-1] * 3 // 2))
    return lows


def range_keys(s: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[int]]:
    """Keys of the hash ranges of a set, for each band in which a partner may look for it.

    The last bits of a key are the parity of its band; for either parity comes the number of keys that a set can do
    without, as a like set shares more than that.
    """
    size, out, spares = len(s), [], [0, 0]
    lows = size_bands(2 * size)
    own = int(np.searchsorted(lows, size, "right")) - 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s))])
        for band in (own, own + 1):
            if band > own and size * den < num * lows[band]:
                continue
            differ = 2 * (lows[band + 1] - 1) * (den - num) // (den + num)
            spare = 1 + differ // 4
            count = differ + 1 + spare
            place = (s >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)
            ends = np.searchsorted(place, np.arange(count + 1, dtype=np.uint64))
            keys = mix(sums[ends[1:]] - sums[ends[:-1]] + mix(np.arange(count, dtype=np.uint64) + np.uint64(band << 40)))
            full = ends[1:] > ends[:-1]
            # At least ``spare`` + 1 ranges are equal; if no more than ``spare`` are empty, one of those is not.
            # A set with more than that keeps all keys: like sets without empty ones share fewer than ``spare`` with it.
            empty = int(count - full.sum())
            keys, spare = (keys[full], spare - empty) if empty <= spare else (keys, 0)
            out.append(keys & ~KIND | np.uint64(band & 1))
            spares[band & 1] = spare
    return np.concatenate(out), spares


def lacking(size: int, num: int, den: int) -> int:
    return size * (den - num) // den


def subset_count(size: int, num: int, den: int) -> int:
    return sum(comb(size, k) for k in range(lacking(size, num, den) + 1))


def subset_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of all subsets that lack no more elements than a partner may."""
    with np.errstate(over="ignore"):
        spread = mix(s)
        whole, size, sums = spread.sum(dtype=np.uint64), len(s), []
        for k in range(lacking(size, num, den) + 1):
            gone = np.array(list(combinations(range(size), k)), np.int64).reshape(comb(size, k), k)
            sums.append(whole - spread[gone].sum(1, dtype=np.uint64) + np.uint64((size - k) << 48))
        return mix(np.concatenate(sums)) | KIND


def _described(source: DataFrame, n: int, num: int, den: int) -> DataFrame:
    largest_light = next(s for s in range(1, 1 << 20) if lacking(s + 1, num, den) > MOST_LACKING)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, light, heavy, spares = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, n)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                alone = len(s) * den // num == len(s)  # no larger partner, so none but equal sets
                light.append(subset_keys(s, num, den).tobytes() if len(s) <= largest_light and not alone else None)
                ranges, spare = (None, [0, 0]) if alone else range_keys(s, num, den)
                heavy.append(None if alone else ranges.tobytes())
                spares.append(spare)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                pa.array(light, pa.binary()), pa.array(heavy, pa.binary()), pa.array(spares, pa.list_(pa.int32())),
            ], names=schema.names)

    schema = T.StructType([
        source.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
        T.StructField("light", T.BinaryType()), T.StructField("heavy", T.BinaryType()),
        T.StructField("spares", T.ArrayType(T.IntegerType())),
    ])
    return source.mapInArrow(describe, schema)


def _boundary(sets: DataFrame, num: int, den: int) -> int:
    """The largest light size, by the least cost over all sets. Collects a row per size of at most 40 or so."""
    counts = {
        r["n_shingles"]: r["count"]
        for r in sets.where(F.col("light").isNotNull()).groupBy("n_shingles").count().collect()
    }
    best = spent = 0
    for size in sorted(counts):
        lows = size_bands(2 * size)
        band = int(np.searchsorted(lows, size, "right")) - 1
        ranges = 2 * (lows[band + 1] - 1) * (den - num) // (den + num) + 2
        spent += counts[size] * (subset_count(size, num, den) - LIST_WEIGHT * ranges)
        if spent <= 0:
            best = size
    return best


def _entries(sets: DataFrame) -> DataFrame:
    """One row per key of every set: ``key, rep, spare``; it can do without as many keys of that kind."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "keys"):
            keys = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
            row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            keys = np.concatenate(keys)
            spares = np.array([[*x, 0, 0] for x in batch.column("spares").to_pylist()], np.int32)
            spare = spares[row, keys & np.int64(KIND)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), batch.column("rep").take(pa.array(row)), pa.array(spare)], names=["key", "rep", "spare"])

    schema = T.StructType([T.StructField("key", T.LongType()), sets.schema["rep"], T.StructField("spare", T.IntegerType())])
    return sets.select("rep", "keys", "spares").mapInArrow(expand, schema)


def _rarest(entries: DataFrame) -> DataFrame:
    """``key, rep`` of the keys that several sets share, without the most frequent ones that a set can do without.

    Like sets share more keys of a kind than either can do without. Of those, the one that is last by frequency and
    key is among the spared ones of neither, so they still meet, and sets that share a few common keys by chance don't.
    """
    # A set has a key once, so a key that is counted twice belongs to two sets.
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(shared, "shared-keys")
    met = entries.join(F.broadcast(shared) if has_at_most(shared, FEW_KEYS) else shared, "key")
    kind = F.col("key").bitwiseAND(F.lit(int(KIND)))
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("rep", kind).orderBy(F.desc("n"), "key")))
    kept = written(met.where("place > spare").select("key", "rep"), "rarest-keys")
    discard(shared)
    return kept


def _elements(source: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The shingle sets of the given documents: ``doc_id, elements``."""
    if has_at_most(ids, FEW_IDS):
        ids = F.broadcast(ids)
    wanted = source.join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t, n) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([x.tobytes() for x in found], pa.binary()),
                pa.array([outline(x) for x in found], pa.binary()),
            ], names=["doc_id", "elements", "outline"])

    return wanted.mapInArrow(sets, T.StructType([
        source.schema["doc_id"], T.StructField("elements", T.BinaryType()), T.StructField("outline", T.BinaryType()),
    ]))


def outline(s: np.ndarray) -> bytes:
    """How many elements of a set have each remainder, some four to a count; the first byte is the width of a count."""
    size = max(OUTLINE, 1 << max(0, len(s) // 4).bit_length())
    counts = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size)
    wide = counts.max(initial=0) > 255
    return (b"\4" if wide else b"\1") + counts.astype("<u4" if wide else np.uint8).tobytes()


def outline_counts(blob: pa.Scalar) -> np.ndarray:
    data = blob.as_buffer()
    return np.frombuffer(data, "<u4" if data[0] == 4 else np.uint8, offset=1).astype(np.int64)


def folded(counts: np.ndarray, size: int) -> np.ndarray:
    """The counts by fewer remainders; sizes are powers of two."""
    return counts.reshape(-1, size).sum(0)


def _possible(pairs: DataFrame, elements: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` whose outlines leave room for the similarity: no like pair is lost, and whole sets need not move."""
    a = elements.select(F.col("doc_id").alias("a"), F.col("outline").alias("of_a"))
    b = elements.select(F.col("doc_id").alias("b"), F.col("outline").alias("of_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = outline_counts(x), outline_counts(y)
                size = min(len(x), len(y))
                most = np.minimum(folded(x, size), folded(y, size)).sum()
                keep.append(bool(den * most >= num * (x.sum() + y.sum() - most)))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    kind = elements.schema["doc_id"].dataType
    joined = pairs.join(a, "a").join(b, "b").select("a", "of_a", "b", "of_b")
    return joined.mapInArrow(compare, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _still_open(members: DataFrame, elements: DataFrame, num: int, den: int) -> DataFrame:
    """Those ``hub, rep`` that some other member of the hub, of another class, may be like by their outlines.

    ``members`` has ``hub, rep, component``. Outlines meet in blocks of bounded size; a block gives members, not pairs.
    """
    sized = members.join(elements.select(F.col("doc_id").alias("rep"), "outline"), "rep")
    dealt = _in_blocks(sized, F.count(F.lit(1)) / OUTLINES)

    def compare(table: pa.Table) -> pa.Table:
        found = [outline_counts(x) for x in table["outline"]]
        size = min(map(len, found))
        total = np.array([x.sum() for x in found])
        counts = np.stack([folded(x, size) for x in found])
        _, component = np.unique(table["component"].to_numpy(), return_inverse=True)
        open_ = np.zeros(len(found), bool)
        for i in range(len(found)):
            near = np.flatnonzero((component != component[i]) & (den * np.minimum(total, total[i]) >= num * np.maximum(total, total[i])))
            most = np.minimum(counts[near], counts[i]).sum(1)
            open_[i] = (den * most >= num * (total[near] + total[i] - most)).any()
        return table.select(["hub", "rep"]).filter(pa.array(open_))

    kind = elements.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("hub", kind), T.StructField("rep", kind)])
    return dealt.groupBy("hub", "i", "j").applyInArrow(compare, schema).distinct()


def _in_blocks(sized: DataFrame, blocks: Column) -> DataFrame:
    """Members of every hub dealt so that any two of them meet in some block ``hub, i, j``, of about two shares."""
    count = sized.groupBy("hub").agg(F.ceil(blocks).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = sized.join(count.select("hub", "blocks"), "hub").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("mine", "other", "blocks")


def _with_elements(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    a = elements.select(F.col("doc_id").alias("a"), F.col("elements").alias("of_a"))
    b = elements.select(F.col("doc_id").alias("b"), F.col("elements").alias("of_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "of_a", "b", "of_b")


def _verified(pairs: DataFrame, elements: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` that are alike enough, as ``src, dst``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "of_b"):
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["src", "dst"])

    kind = elements.schema["doc_id"].dataType
    return _with_elements(pairs, elements).mapInArrow(compare, T.StructType([T.StructField("src", kind), T.StructField("dst", kind)]))


def _in_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the keys whose members are in several classes by now, with their class."""
    near = connected_components(links)
    placed = members.join(near, members["rep"] == near["node"], "left").select(
        *members.columns, F.coalesce("component", "rep").alias("component")
    )
    several = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d")
    return written(placed.join(several.select("key"), "key", "left_semi"), "open-keys")


def connected(alike: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest row it is connected with."""
    label = np.arange(len(alike))
    while True:
        near = np.where(alike, label[None, :], len(alike)).min(1, initial=len(alike))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def alike_sets(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets are alike enough, by the product of their incidence matrix with itself, some columns at a time."""
    sizes = np.array([len(x) for x in sets])
    which = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Elements of one set alone are shared by none.
    several = count[column] > 1
    which, column = which[several], (np.cumsum(count > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    which, column = which[order], column[order]
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # counts must be exact
    shared = np.zeros((len(sets), len(sets)), kind)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), kind)
        held[which[a:b], column[a:b] - start] = 1
        shared += held @ held.T
    shared = shared.astype(np.int64)
    return den * shared >= num * (sizes[:, None] + sizes[None, :] - shared)


def _within_hubs(open_: DataFrame, elements: DataFrame, num: int, den: int) -> DataFrame:
    """Links ``src, dst`` that connect the like ones among the members of each hub. Whole sets move for those members
    only that may be like another by their outlines."""
    kind = elements.schema["doc_id"].dataType
    members = open_.where("rep <> hub").select("hub", "rep", "component").distinct()
    members = written(_still_open(members, elements, num, den), "open-members")
    sized = members.join(elements.select(F.col("doc_id").alias("rep"), "elements"), "rep")
    size = F.sum(F.octet_length("elements")) / (8 * BLOCK)
    dealt = _in_blocks(sized, F.greatest(size, F.count(F.lit(1)) / SETS)).select("hub", "i", "j", "rep", "elements")

    def compare(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["elements"]]
        label = connected(alike_sets(sets, num, den)) if len(sets) > 1 else np.arange(len(sets))
        at = np.flatnonzero(label != np.arange(len(label)))
        reps = table["rep"].combine_chunks()
        return pa.table([reps.take(pa.array(label[at])), reps.take(pa.array(at))], names=["src", "dst"])

    schema = T.StructType([T.StructField("src", kind), T.StructField("dst", kind)])
    return dealt.groupBy("hub", "i", "j").applyInArrow(compare, schema)


def _linked(entries: DataFrame, source: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links ``src, dst`` that connect every two like sets that share a key."""
    rarest = _rarest(entries)
    hubs = rarest.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hubs = written(hubs.select("key", "hub"), "hubs")
    members = written(rarest.join(F.broadcast(hubs) if has_at_most(hubs, FEW_KEYS) else hubs, "key"), "members")
    elements = written(_elements(source, members.select("rep").distinct(), n), "candidate-sets")
    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    stars = written(_possible(stars, elements, num, den), "possible-pairs")
    links = written(_verified(stars, elements, num, den), "links")
    links = links.unionByName(written(_within_hubs(_in_classes(members, links), elements, num, den), "links"))
    discard(rarest, hubs, members, elements, stars)  # what follows reads the links alone
    return links


def similar_classes(
    df: DataFrame, n: int = 5, similarity_percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: the class of texts linked by similar shingle sets.

    Words are runs of anything but blank and 0x09 to 0x0D, with A-Z lower-cased; a set holds the distinct runs of
    ``n`` words. Two texts link if ``100 * shared >= similarity_percent * united``. ``component_id`` is the smallest
    id reachable by links. Null and blank texts have an empty set and are their own class. Rows that repeat an id and
    a text are alike; if the texts differ, each row has the class of its own set. Rows with a null id come out with a
    null class. An empty table gives no rows. Other columns are not read.
    """
    num, den = similarity_percent, 100
    source = id_and_text(df, id_col, text_col)
    sets = written(_described(source, n, num, den), "shingle-sets")
    known = sets.where(F.col("doc_id").isNotNull())
    classes = known.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("rep"))

    boundary = _boundary(known, num, den)
    size = F.col("n_shingles")
    keys = F.when(size > boundary, F.col("heavy")).when(
        size * den >= num * (boundary + 1), F.concat("light", "heavy")
    ).otherwise(F.coalesce("light", "heavy"))
    distinct = known.select("digest", "doc_id", keys.alias("keys"), "spares").where(F.col("keys").isNotNull())
    distinct = distinct.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "keys", "spares")).alias("s")).select("s.*")
    linked = connected_components(_linked(_entries(distinct), source, n, num, den))

    named = classes.join(linked, classes["rep"] == linked["node"], "left").select(
        "digest", F.coalesce("component", "rep").alias("of_set")
    )
    rows = sets.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return rows.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id")).alias("component_id")
    )
