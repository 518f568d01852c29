"""Removal of passages that an earlier document holds, by a parse of every document relative to all earlier ones.

The reference blocks are windows of ``window`` words. They are indexed in two steps. First each window is stood for by
its least run of ``RUN`` words, its anchor: a fifth of the positions suffice, as equal windows have equal anchors.
Only documents that share an anchor with another go on, and only their windows with shared anchors are indexed under
96-bit hashes, with the smallest document that holds them. The parse then goes greedily through a document: a factor
is as long a run of windows known from earlier documents as there is, every window at its boundary is checked as well,
and factors of at least ``window`` words are cut out.

Hashes travel packed, many to a row, dealt by their leading bits. Before that a worker settles what it can within its
slice of texts: of a window in several texts of a slice one goes out. So a passage in a third of all documents costs a
row per slice, not per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import ascii_words, gram_hashes, id_and_text, mix, slices, word_hashes

RUN = 5
BUCKET_BYTES = 16 << 20  # text per bucket of hashes: with all that a task needs to sort them, some 70 MB
SLICE = 4 << 20  # text that a worker settles at once

WHOLE, BYTES = T.LongType(), T.BinaryType()
SENT = T.StructType([
    T.StructField("bucket", WHOLE), T.StructField("doc_id", WHOLE), T.StructField("keys", BYTES),
    T.StructField("checks", BYTES), T.StructField("docs", BYTES), T.StructField("places", BYTES),
])
#: Answers to a group of documents: their ids, how many keys each has, and the keys.
ANSWER = T.StructType([
    T.StructField("group", WHOLE), T.StructField("docs", BYTES), T.StructField("counts", BYTES), T.StructField("keys", BYTES),
])

SENT_ARROW = pa.schema([(f.name, pa.int64() if f.dataType == WHOLE else pa.binary()) for f in SENT.fields])


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For every window of words, in order, the least hash of a run in it."""
    least, width = gram_hashes(words, min(RUN, window)), 1
    want = window - min(RUN, window) + 1
    if len(least) < want:
        return np.empty(0, np.uint64)
    while width < want:
        step = min(width, want - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    return least


def factors(known: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word spans of the greedy parse: each factor covers as long a run of known windows as there is.

    Factors that meet or overlap, as every window at a boundary is checked, are one span.
    """
    spans: list[tuple[int, int]] = []
    starts = np.flatnonzero(known & ~np.concatenate([[False], known[:-1]])).tolist()
    ends = np.flatnonzero(known & ~np.concatenate([known[1:], [False]])).tolist()
    for start, end in zip(starts, ends):
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], end + window)
        else:
            spans.append((start, end + window))
    return spans


def _per_document(docs: np.ndarray, keys: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(docs):
        return [], []
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    return docs[starts].tolist(), np.split(keys, starts[1:])


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    bucket, doc, *packed = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int64()), pa.array(doc, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=SENT.names)


def _deal(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray, buckets: int) -> Iterator[tuple]:
    """Rows of sorted keys, one per bucket; the bucket is the place of a key among all hashes.

    ``docs`` holds the ids of a row once, and ``places`` which of them each key has.
    """
    place = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(keys) else []
    for a, b in zip(starts, [*starts[1:], len(keys)]):
        ids, at = np.unique(docs[a:b], return_inverse=True)
        yield int(place[a]), None, keys[a:b].tobytes(), checks[a:b].tobytes(), ids.tobytes(), at.astype("<u4" if len(ids) > 1 << 16 else "<u2").tobytes()


def _send_anchors(window: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            ids = batch.column("doc_id").to_pylist()
            each = [np.unique(anchors(word_hashes(ascii_words(t)), window)) for t in batch.column("text").to_pylist()]
            keys = np.concatenate(each)
            docs = np.repeat(np.array(ids, np.int64), [len(x) for x in each])
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
            alone = first & np.concatenate([first[1:], [True]]) if len(keys) else first
            # An anchor of several texts is settled here; others only learn that it is shared.
            rows = list(_deal(keys[first], (~alone[first]).astype(np.uint8), docs[first], buckets))
            for doc, part in zip(*_per_document(docs[~alone], keys[~alone])):
                rows.append((doc % buckets, doc, part.tobytes(), None, None, None))
            if rows:
                yield _sent(rows)

    return send


def _gathered(table: pa.Table):
    """What arrived in one bucket: documents and keys settled before, and the packed arrays of the others."""
    settled = table.filter(pc.is_valid(table["doc_id"]))
    parts = [np.frombuffer(x, np.uint64) for x in settled["keys"].to_pylist()]
    before = (
        np.repeat(np.array(settled["doc_id"].to_pylist(), np.int64), [len(x) for x in parts]),
        np.concatenate(parts) if parts else np.empty(0, np.uint64),
    )
    dealt = table.filter(pc.is_null(table["doc_id"]))

    def joined(name, kind):
        return np.frombuffer(b"".join(dealt[name].to_pylist()), kind)

    docs = [np.empty(0, np.int64)]
    for ids, places in zip(dealt["docs"].to_pylist(), dealt["places"].to_pylist()):
        ids = np.frombuffer(ids, np.int64)
        docs.append(ids[np.frombuffer(places, "<u4" if len(ids) > 1 << 16 else "<u2")])
    return before, joined, np.concatenate(docs)


def _answers(before: tuple, docs: np.ndarray, keys: np.ndarray, groups: int) -> pa.Table:
    """One row per group of documents, whatever the number of documents."""
    docs, keys = np.concatenate([before[0], docs]), np.concatenate([before[1], keys])
    order = np.lexsort((docs, docs % groups))
    docs, keys = docs[order], keys[order]
    cuts = np.flatnonzero(docs[1:] % groups != docs[:-1] % groups) + 1
    rows = []
    for of_group, of_keys in zip(np.split(docs, cuts), np.split(keys, cuts)) if len(docs) else []:
        ids, counts = np.unique(of_group, return_counts=True)
        rows.append((int(ids[0] % groups), ids.tobytes(), counts.astype("<u4").tobytes(), of_keys.tobytes()))
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=ANSWER.names)


def _keys_of(answers: pa.Table) -> dict[int, np.ndarray]:
    """The distinct keys of each document of a group."""
    docs, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for ids, counts, part in zip(*(answers[c].to_pylist() for c in ("docs", "counts", "keys"))):
        docs.append(np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, "<u4")))
        keys.append(np.frombuffer(part, np.uint64))
    return {doc: np.unique(part) for doc, part in zip(*_per_document(np.concatenate(docs), np.concatenate(keys)))}


def _shared_anchors(groups: int):
    """Anchors that two slices sent, or one that found it in two texts."""

    def answer(table: pa.Table) -> pa.Table:
        before, joined, docs = _gathered(table)
        keys, several = joined("keys", np.uint64), joined("checks", np.uint8)
        order = np.argsort(keys, kind="stable")
        keys, several, docs = keys[order], several[order], docs[order]
        if not len(keys):
            return _answers(before, docs, keys, groups)
        group = np.cumsum(np.concatenate([[True], keys[1:] != keys[:-1]])) - 1
        shared = (np.bincount(group) > 1) | (np.bincount(group, several) > 0)
        asks = shared[group] & (several == 0)
        return _answers(before, docs[asks], keys[asks], groups)

    return answer


def _send_windows(window: int, buckets: int):
    def settle(batch: pa.RecordBatch, shared: dict[int, np.ndarray]) -> list[tuple]:
        all_keys, all_checks, all_docs = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if doc not in shared:
                continue
            words = word_hashes(ascii_words(text))
            here = np.isin(anchors(words, window), shared[doc])
            keys = gram_hashes(words, window)[here]
            checks = gram_hashes(mix(words ^ np.uint64(0x5851F42D4C957F2D)), window)[here]
            all_keys.append(keys)
            all_checks.append((checks >> np.uint64(32)).astype(np.uint32))
            all_docs.append(np.full(len(keys), doc, np.int64))
        if not sum(map(len, all_keys)):
            return []
        keys, checks, docs = np.concatenate(all_keys), np.concatenate(all_checks), np.concatenate(all_docs)
        order = np.lexsort((docs, checks, keys))
        keys, checks, docs = keys[order], checks[order], docs[order]
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])])
        smallest = docs[first][np.cumsum(first) - 1]
        later = docs > smallest
        rows = list(_deal(keys[first], checks[first], docs[first], buckets))
        for doc, part in zip(*_per_document(docs[later], keys[later])):
            rows.append((doc % buckets, doc, np.unique(part).tobytes(), None, None, None))
        return rows

    def send(texts: pa.Table, answers: pa.Table) -> pa.Table:
        shared = _keys_of(answers)
        batches = slices(texts.to_batches(), most=SLICE) if shared else []
        sent = [_sent(rows) for batch in batches if (rows := settle(batch, shared))]
        return pa.Table.from_batches(sent, SENT_ARROW)

    return send


def _later_windows(groups: int):
    """Windows that a slice with a smaller document sent, too."""

    def answer(table: pa.Table) -> pa.Table:
        before, joined, docs = _gathered(table)
        keys, checks = joined("keys", np.uint64), joined("checks", np.uint32)
        order = np.lexsort((docs, checks, keys))
        keys, checks, docs = keys[order], checks[order], docs[order]
        if not len(keys):
            return _answers(before, docs, keys, groups)
        first = np.concatenate([[True], (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])])
        later = docs > docs[first][np.cumsum(first) - 1]
        return _answers(before, docs[later], keys[later], groups)

    return answer


def _cut(batch: pa.RecordBatch, known: dict[int, np.ndarray], window: int) -> pa.RecordBatch:
    counts, gone, kept, spans = [], [], [], []
    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        words = ascii_words(text)
        found = []
        if doc in known:
            found = factors(np.isin(gram_hashes(word_hashes(words), window), known[doc]), window)
        left, at = [], 0
        for start, end in found:
            left += words[at:start]
            at = end
        left += words[at:]
        counts.append(len(words))
        gone.append(len(words) - len(left))
        kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        spans.append([{"start": a, "end": b} for a, b in found])
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    carried = ["text", "others"] if "others" in batch.schema.names else []
    return pa.RecordBatch.from_arrays([
        batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
        pa.array(kept, pa.string()), pa.array(spans, pa.list_(pair)), *map(batch.column, carried),
    ], names=["doc_id", "n_words", "n_removed", "kept", "spans", *carried])


def _prime_from(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def remove_repeated_passages(
    df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, spans`` for every row: texts without what a smaller id holds already.

    Words are runs of anything but blank and 0x09 to 0x0D. A word goes if it lies in ``window`` consecutive words that
    also start somewhere in a document of smaller id; all windows are judged on the input. ``kept`` joins the other
    words by single blanks; ``spans`` are the word positions cut out. Null, empty and shorter texts lose nothing.
    Rows that repeat an id are one document: they lose nothing to each other and the same windows to smaller ids. Rows
    without an id lose nothing and take nothing. Ids are whole numbers. Other columns are not read, unless
    ``with_rows`` asks for ``text``, the text as it was, and ``others``, the other columns of the row, besides.
    """
    all_rows = id_and_text(df, id_col, text_col)
    if with_rows:
        row = F.struct(F.col(text_col).isNull().alias("blank"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text_col]).alias("columns"))
        all_rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), row.alias("others"))
    if all_rows.schema["doc_id"].dataType != WHOLE:
        all_rows = all_rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    docs = all_rows.where(F.col("doc_id").isNotNull())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A prime, as documents are grouped by the remainder of their id.
    buckets = _prime_from(max(2 * df.sparkSession.sparkContext.defaultParallelism, size // BUCKET_BYTES))
    docs = docs.withColumn("group", F.pmod("doc_id", F.lit(buckets)))

    sent = docs.select("doc_id", "text").mapInArrow(_send_anchors(window, buckets), SENT)
    shared = sent.groupBy("bucket").applyInArrow(_shared_anchors(buckets), ANSWER)
    sent = docs.select("doc_id", "text", "group").groupBy("group").cogroup(shared.groupBy("group")).applyInArrow(_send_windows(window, buckets), SENT)
    later = sent.groupBy("bucket").applyInArrow(_later_windows(buckets), ANSWER)
    schema = T.StructType([
        T.StructField("doc_id", WHOLE), T.StructField("n_words", WHOLE), T.StructField("n_removed", WHOLE),
        T.StructField("kept", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", WHOLE), T.StructField("end", WHOLE)]))),
        *([T.StructField("text", T.StringType()), all_rows.schema["others"]] if with_rows else []),
    ])
    columns = all_rows.columns

    def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = _keys_of(answers)
        batches = [_cut(batch, known, window) for batch in slices(texts.select(columns).to_batches())]
        return pa.Table.from_batches(batches or [_cut(pa.RecordBatch.from_pylist([], texts.select(columns).schema), {}, window)])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _cut(batch, {}, window)

    found = docs.groupBy("group").cogroup(later.groupBy("group")).applyInArrow(cut, schema)
    found = found.unionByName(all_rows.where(F.col("doc_id").isNull()).mapInArrow(keep, schema))
    if not with_rows:
        return found
    return found.withColumns({"text": F.when(~F.col("others.blank"), F.col("text")), "others": F.col("others.columns")})
