"""Homomorphic fingerprints: the sum, modulo powers of two, of a wide vector hashed from every paragraph.

A paragraph is a line. Its vector has ``LANES`` lanes of 32 bits, all hashed from the whole paragraph, and ``SKETCH``
lanes of 32 bits, in which each run of three words of the paragraph counts one up or down. Sums don't depend on the
order, and a paragraph is inserted or deleted by adding or subtracting its vector alone. Equal texts have equal
fingerprints; the first lanes tell different multisets of paragraphs apart, the others are a sketch of which the
cosine estimates how much two texts share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import gram_hashes, id_and_text, mix, word_hashes

LANES, SKETCH, RUN = 16, 192, 3
PARTITION_BYTES = 32 << 20
_STEPS = mix(np.arange(1, LANES + 1, dtype=np.uint64))


def paragraphs(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def vector(parts: list[bytes]) -> np.ndarray:
    """The fingerprint of a multiset of paragraphs, as 32-bit lanes of either kind in one array of bytes."""
    lanes, sketch = np.zeros(LANES, np.uint32), np.zeros(SKETCH, np.int64)
    if parts:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
        for start in range(0, len(hashes), 4096):
            lanes += (mix(hashes[start:start + 4096, None] ^ _STEPS) >> np.uint64(32)).astype(np.uint32).sum(0, dtype=np.uint32)
        split = [p.split() for p in parts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = word_hashes([w for p in split for w in p])
        runs = gram_hashes(words, RUN)
        if len(runs):
            # Runs stay within a paragraph, so that its vector depends on nothing else.
            owner = np.repeat(np.arange(len(sizes)), sizes)
            runs = runs[owner[:len(runs)] == owner[RUN - 1:]]
        ends = np.cumsum(sizes)
        short = [int(words[a:b].sum(dtype=np.uint64)) for a, b in zip(ends - sizes, ends) if 0 < b - a < RUN]
        if short:
            runs = np.concatenate([runs, mix(np.array(short, np.uint64))])
        at, sign = (runs >> np.uint64(8)) % np.uint64(SKETCH), 1.0 - 2.0 * (runs & np.uint64(1)).astype(float)
        sketch = np.bincount(at.astype(np.int64), weights=sign, minlength=SKETCH).astype(np.int64)
    return np.concatenate([lanes.view(np.uint8), (sketch & 0xFFFFFFFF).astype("<u4").view(np.uint8)])


def _lanes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v[:4 * LANES].view("<u4"), v[4 * LANES:].view("<u4")


def changed(fingerprint: np.ndarray, inserted: list[bytes] = (), deleted: list[bytes] = ()) -> np.ndarray:
    """The fingerprint after paragraphs came and went; only those are read."""
    (a, b), (ai, bi), (ad, bd) = _lanes(fingerprint), _lanes(vector(list(inserted))), _lanes(vector(list(deleted)))
    return np.concatenate([(a + ai - ad).view(np.uint8), (b + bi - bd).view(np.uint8)])


def as_text(v: np.ndarray) -> str:
    return base64.b64encode(v.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint8)


def likeness_of(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: 1 for equal fingerprints, else the cosine of the sketches where it is positive."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[4 * LANES:].view("<i4").astype(float) for v in (a, b))
    scale = float(np.sqrt((x @ x) * (y @ y)))
    return max(0.0, min(1.0, float(x @ y) / scale)) if scale else 0.0


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column as base64; null is as empty."""

    def take(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([as_text(vector(paragraphs(t or ""))) for t in texts], dtype=object)

    return F.pandas_udf(take, "string")(text)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two columns of fingerprints; null if either is null."""

    def compare(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            yield pd.Series([
                None if x is None or y is None else likeness_of(from_text(x), from_text(y)) for x, y in zip(xs, ys)
            ], dtype="float64")

    return F.pandas_udf(compare, "double")(a, b)


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit with the next one: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    Rows go in ascending order of their id (then of their text, if ids repeat; null ids first), and after the last
    comes the first. In the edit the last floor(n_chars / 2) code points give way to as many of the beginning of the
    next text, or to all of it. Null is as empty; a single row is its own next. Other columns are not read.

    Texts move once: to ranges of ids, whose first row also goes to the end of the range before.
    """
    source = id_and_text(df, id_col, text_col)
    lowest = F.lit(-(1 << 63)).cast("bigint")
    source = source.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), lowest).alias("place"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(2 * df.sparkSession.sparkContext.defaultParallelism, size // PARTITION_BYTES))
    cuts = [i / parts for i in range(1, parts)]
    found = source.agg(F.min("place").alias("first"), F.percentile_approx("place", cuts, 100 * parts).alias("cuts")).first()
    first = found["first"]
    heads = np.array(sorted(set(found["cuts"] or ()) - {first}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.array(batch.column("place").to_pylist(), np.int64)
            part = np.searchsorted(heads, places, "right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array(np.zeros(len(part), bool)), *batch.columns], names=["part", "tail", *batch.schema.names])
            head = np.flatnonzero(np.isin(places, heads) | (places == first))
            if len(head):
                to = np.where(part[head] > 0, part[head] - 1, len(heads))
                rows = batch.take(pa.array(head))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to), pa.array(np.ones(len(head), bool)), *rows.columns], names=["part", "tail", *batch.schema.names])

    dealt = source.mapInArrow(deal, T.StructType([
        T.StructField("part", T.LongType()), T.StructField("tail", T.BooleanType()), *source.schema.fields,
    ]))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part", "tail", "place", "text")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, id, text and fingerprint of the row that waits for its next
        for batch in batches:
            out = []
            for part, tail, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text"))):
                if tail and (last is None or last[0] != part):
                    continue  # a later one of several rows with the first id
                own = vector(paragraphs(text))
                if last is not None:
                    _, before_id, before, before_print = last
                    half = len(before) // 2
                    edited = before[:len(before) - half] + text[:half]
                    print_ = vector(paragraphs(edited))
                    out.append((
                        before_id, len(before), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                        as_text(before_print), as_text(print_), likeness_of(before_print, print_), likeness_of(before_print, own),
                    ))
                last = None if tail else (part, doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array(column, kind) for column, kind in zip(zip(*out), (
                        batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))
                ], names=schema.names)

    word, real = T.StringType(), T.DoubleType()
    schema = T.StructType([
        source.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", word),
        T.StructField("fingerprint", word), T.StructField("edited_fingerprint", word),
        T.StructField("near_edited", real), T.StructField("near_next", real),
    ])
    return dealt.mapInArrow(edit, schema)
