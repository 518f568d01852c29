"""Token sequences in training order: a keyed permutation gives every sequence its place, and shards have a fixed stride.

Documents are tokenised once and written with the number of sequences each partition has; those numbers make every
sequence's ordinal. A Feistel network over the next even power of two permutes ordinals, and walks on along its cycle
while it is outside of the count, which makes it a permutation of the ordinals themselves. So the order needs no sort
by random numbers and no table: slot and ordinal follow from each other by the key. Ranges of slots are shards; record
i of a shard starts at byte ``i * stride``, so a reader seeks to any step and resumes there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from topicloom.llm.common import id_and_text, mix, slices, written
from topicloom.llm.word_ids import loaded, read_tokenizer

LENGTH = 2048
ROUNDS = 6


def permuted(x: np.ndarray, count: int, key: int, back: bool = False) -> np.ndarray:
    """The place of every ordinal below ``count``, or with ``back`` the ordinal at every place."""
    half = max(1, -(-max(1, (count - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = mix(np.uint64(key % (1 << 64)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = x.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> shift, out[walking] & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        out[walking] = left << shift | right
        walking = out >= count
    return out.astype(np.int64)


def token_sequences(
    df: DataFrame, tokenizer_path: str, end_id: int, key: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``slot, doc_id, part, n_tokens, tokens``: documents cut into sequences of ``length`` tokens, with their global slots.

    A document is its ids and ``end_id``; its last sequence may be short. ``tokens`` are little-endian unsigned 16-bit
    integers, without padding. Slots run from 0 to the number of sequences less one, each once. Null and empty texts
    are ``end_id`` alone; repeated rows and null ids are documents like any other; an empty table has no sequence.
    Other columns are not read. Only a number per partition comes to the driver. A vocabulary or ``end_id`` beyond 16
    bits is an error.
    """
    source = id_and_text(df, id_col, text_col)
    sc = df.sparkSession.sparkContext
    tokenizer = read_tokenizer(tokenizer_path)
    largest = max(end_id, *Tokenizer.from_str(tokenizer).get_vocab().values())
    if largest > 0xFFFF:
        raise ValueError(f"id {largest} does not fit into 16 bits")
    file = sc.broadcast(tokenizer)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, split, at = loaded(file.value), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids = [np.frombuffer(x + end, "<u4").astype("<u2").tobytes() for x in words.encode(batch.column("text").to_pylist())]
            counts = np.array([-(-len(x) // (2 * length)) for x in ids], np.int64)
            first = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), split)), pa.array(first), pa.array(counts),
            ], names=tokens.names)

    whole, raw = T.LongType(), T.BinaryType()
    tokens = T.StructType([
        source.schema["doc_id"], T.StructField("ids", raw), T.StructField("split", whole), T.StructField("first", whole),
        T.StructField("n", whole),
    ])
    table = written(source.mapInArrow(tokenise, tokens), "tokens")
    per_split = sorted((r["split"], r["n"]) for r in table.groupBy("split").agg(F.sum("n").alias("n")).collect())
    bases, count = {}, 0
    for split, n in per_split:
        bases[split], count = count, count + n
    bases = sc.broadcast(bases)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            docs, parts, pieces, ordinals = [], [], [], []
            for row, (ids, split, first, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ids", "split", "first", "n")))):
                docs += [row] * n
                parts += range(n)
                pieces += [ids[2 * length * i:2 * length * (i + 1)] for i in range(n)]
                ordinals += range(bases.value[split] + first, bases.value[split] + first + n)
            yield pa.RecordBatch.from_arrays([
                pa.array(permuted(np.array(ordinals, np.int64), count, key)), batch.column("doc_id").take(pa.array(docs, pa.int64())),
                pa.array(parts, pa.int64()), pa.array([len(x) // 2 for x in pieces], pa.int64()), pa.array(pieces, pa.binary()),
            ], names=out.names)

    out = T.StructType([
        T.StructField("slot", whole), source.schema["doc_id"], T.StructField("part", whole), T.StructField("n_tokens", whole),
        T.StructField("tokens", raw),
    ])
    return table.mapInArrow(place, out)


def in_shards(sequences: DataFrame, per_shard: int, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """``shard, record, slot, doc_id, part, n_tokens, bytes``: what every shard holds, in the order of the records.

    Shards are ranges of slots, dealt by range and sorted by slot, so tasks stream through records of a fixed size
    whatever the size of the data. ``bytes`` are the tokens padded to ``length``.
    """
    dealt = sequences.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("bigint"))
    dealt = dealt.repartitionByRange("shard").sortWithinPartitions("slot")
    missing = (F.lit(length) - F.col("n_tokens")).cast("int")
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(2, "little").hex()), missing))
    return dealt.select(
        "shard", (F.col("slot") % per_shard).alias("record"), "slot", "doc_id", "part", "n_tokens", F.concat("tokens", pad).alias("bytes")
    )


def write_shards(sequences: DataFrame, path: str, per_shard: int, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """Write ``shard-<number>.bin`` below ``path``, a URI or folder that all executors reach; ``shard, n_sequences`` is returned.

    A task writes its shards one after the other, each under a name of its attempt, and moves it when it is whole. So
    a task that runs again does no harm, and a run that broke off leaves whole shards only.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        attempt, shard, count, stream, done = TaskContext.get().taskAttemptId(), None, 0, None, []

        def close() -> None:
            if stream is not None:
                stream.close()
                name = f"{folder}/shard-{shard:08d}.bin"
                store.move(f"{name}.{attempt}", name)
                done.append((shard, count))

        for batch in batches:
            for number, record in zip(batch.column("shard").to_pylist(), batch.column("bytes")):
                if number != shard:
                    close()
                    shard, count = number, 0
                    stream = store.open_output_stream(f"{folder}/shard-{shard:08d}.bin.{attempt}")
                stream.write(record.as_buffer())
                count += 1
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())], names=["shard", "n_sequences"])

    rows = in_shards(sequences, per_shard, length, pad_id).select("shard", "bytes")
    return written(rows.mapInArrow(write, "shard bigint, n_sequences bigint"), "shards")


def read_sequence(path: str, slot: int, per_shard: int, length: int = LENGTH) -> np.ndarray:
    """The tokens at a slot, padding included, by one seek."""
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_file(f"{folder}/shard-{slot // per_shard:08d}.bin") as f:
        f.seek(slot % per_shard * 2 * length)
        return np.frombuffer(f.read(2 * length), "<u2")
