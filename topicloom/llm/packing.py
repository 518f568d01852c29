"""Harmonic packing: documents become pieces of reciprocal lengths, and k pieces of class k fill one sequence.

A remainder of r tokens belongs to class k = capacity // r: k such pieces fit a sequence. If k of them would leave
more than ``slack`` tokens of padding, capacity // (k + 1) tokens are cut off, which fill a sequence of class k + 1
almost wholly, and the rest is classed anew. A class needs no knowledge of any other, so every worker fills its own
bins while it reads: no shuffle, and at most one open bin per class (about 90) in memory. When a worker's rows end,
its open bins are run together and cut at the capacity; what then remains is cut into powers of two, which need no
padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import id_and_text, slices
from topicloom.llm.word_ids import loaded, read_tokenizer

CAPACITY = 2048
PARTITION_BITS = 40  # of a sequence id: above these bits stands the number of the partition


def cut_lengths(tokens: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """``(length, class)`` of the pieces of a document, in order."""
    full, rest = divmod(tokens, capacity)
    pieces = [(capacity, 1)] * full
    while rest:
        k = capacity // rest
        if capacity - k * rest <= slack:
            pieces.append((rest, k))
            break
        length = capacity // (k + 1)
        pieces.append((length, k + 1))
        rest -= length
    return pieces


class Packer:
    """The open bins of one worker. ``out`` holds finished rows: document, start, ids, document's tokens, sequence, offset."""

    def __init__(self, capacity: int, slack: int, first_id: int):
        self.capacity, self.slack, self.next_id = capacity, slack, first_id
        self.bins: dict[int, list] = {}
        self.out: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        start, total = 0, len(ids) // 4
        for length, k in cut_lengths(total, self.capacity, self.slack):
            bin_ = self.bins.setdefault(k, [])
            bin_.append((doc, start, ids[4 * start:4 * (start + length)], total))
            start += length
            if len(bin_) == k:
                self.close(self.bins.pop(k))

    def finish(self) -> None:
        """The open bins, one after the other, cut at the capacity and at last into powers of two."""
        rest = [piece for k in sorted(self.bins) for piece in self.bins[k]]
        self.bins = {}
        left = sum(len(piece[2]) // 4 for piece in rest)
        held, room = [], 0
        for doc, start, ids, total in rest:
            while ids:
                if not room:
                    room = min(left, self.capacity) if left > self.capacity - self.slack else 1 << left.bit_length() - 1
                part = ids[:4 * room]
                held.append((doc, start, part, total))
                count = len(part) // 4
                ids, start, room, left = ids[len(part):], start + count, room - count, left - count
                if not room:
                    self.close(held)
                    held = []


def harmonic_pack(
    df: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, slack: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of packed sequences: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Every id lies in exactly one
    piece, and pieces stand without gap in their sequence. ``ids`` are packed little-endian unsigned 32-bit integers.
    Repeated rows and null document ids are packed like any other row; other columns are not read; an empty table
    gives no piece. ``slack`` (a 64th of the capacity) bounds the padding of a sequence that isn't a power of two.
    Sequence ids are unique but not dense; a task that is run again gives the same ids, as a partition's rows are read
    in the same order.
    """
    slack = capacity // 64 if slack is None else slack
    source = id_and_text(df, id_col, text_col)
    file = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    id_type = source.schema["doc_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = loaded(file.value), end_id.to_bytes(4, "little")
        packer = Packer(capacity, slack, TaskContext.get().partitionId() << PARTITION_BITS)
        kind = pa.int64()

        def rows() -> pa.RecordBatch:
            docs, starts, ids, totals, sequences, offsets = zip(*packer.out)
            packer.out = []
            return pa.RecordBatch.from_arrays([
                pa.array(docs, kind), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array(ids, pa.binary()), pa.array(totals, pa.int64()), pa.array(sequences, pa.int64()),
                pa.array(offsets, pa.int64()),
            ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in slices(batches):
            kind = batch.schema.field("doc_id").type
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(batch.column("text").to_pylist())):
                packer.add(doc, ids + end)
            if packer.out:
                yield rows()
        packer.finish()
        if packer.out:
            yield rows()

    whole = T.LongType()
    schema = T.StructType([
        id_type, T.StructField("start", whole), T.StructField("length", whole), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", whole), T.StructField("sequence_id", whole), T.StructField("offset", whole),
    ])
    return source.mapInArrow(pack, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, n_pieces, n_tokens, ids``: the packed sequences themselves, pieces in order of their offset.

    A sequence has at most as many pieces as the capacity, so no group grows with the data.
    """
    in_order = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(in_order, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("n_tokens"), joined.alias("ids")
    )
