"""Byte-level BPE. The pairs of a piece stand in a segment tree whose root is the leftmost pair of least rank.

A merge changes three leaves: the merged pair, the pair before and the pair that is swallowed. Each is a point
update of logarithmic cost, so a piece of n bytes takes n log n steps even if it is one run of letters of
megabytes. Pieces of up to 65 bytes, nearly all there are, go through the same trees side by side: row p of a
matrix is the tree of piece p, and one numpy step merges one pair in every piece.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import id_and_text, slices

NONE = 1 << 30
WIDEST = 64  # leaves of a tree that is a row of a matrix
LONGEST = 64  # characters of a run, bytes of a piece, that is remembered; caches hold some 150 MB at most
CACHED = 120_000  # runs that a worker remembers since it last put its older half aside; as many of those, and of pieces


def read_ranks(path: str) -> bytes:
    """A file of base64 tokens and ranks, read once on the driver; workers get its bytes."""
    with open(path, "rb") as f:
        return f.read()


class Bpe:
    """Encoder and decoder for one vocabulary. Ids are handled as packed little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        get = self.ranks.get
        self.byte_ids = np.array([get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NONE)
        both = self.byte_ids[:, None] << 32 | self.byte_ids[None, :]
        self.byte_pairs = self._rank_of(both.ravel()).reshape(256, 256)
        self.pieces: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}

    def _rank_of(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge_one(self, piece: bytes) -> bytes:
        """One piece of any length by its own segment tree."""
        n = len(piece)
        tokens = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        width = 1 << max(0, (n - 2).bit_length())
        bits = width.bit_length()
        none, pairs = NONE << bits, self.pairs
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pairs.get(tokens[i] << 32 | tokens[i + 1])
            if rank is not None:
                tree[width + i] = rank << bits | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(leaf: int, value: int) -> None:
            i = width + leaf
            tree[i] = value
            while i > 1:
                i >>= 1
                least = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == least:
                    return
                tree[i] = least

        while tree[1] < none:
            at, rank = tree[1] & (1 << bits) - 1, tree[1] >> bits
            gone = after[at]
            beyond = after[gone]
            tokens[at], tokens[gone], after[at] = rank, -1, beyond
            before[beyond] = at
            if gone < width:
                put(gone, none)
            found = pairs.get(rank << 32 | tokens[beyond]) if beyond < n else None
            put(at, none if found is None else found << bits | at)
            if (left := before[at]) >= 0:
                found = pairs.get(tokens[left] << 32 | rank)
                put(left, none if found is None else found << bits | left)
        return np.array([t for t in tokens if t >= 0], "<u4").tobytes()

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of 2 to ``width`` + 1 bytes, each a row of one matrix of segment trees."""
        count, span = len(pieces), width + 1
        data = np.frombuffer(b"".join(p.ljust(span + 1, b"\0") for p in pieces), np.uint8).reshape(count, span + 1)
        sizes = np.fromiter(map(len, pieces), np.int64, count)
        tokens = self.byte_ids[data]
        tokens[np.arange(span + 1) >= sizes[:, None]] = -1
        after = np.tile(np.arange(1, span + 2), (count, 1))
        before = np.tile(np.arange(-1, span), (count, 1))
        tree = np.full((count, 2 * width), NONE << 7, np.int64)
        first = self.byte_pairs[data[:, :width], data[:, 1:span]] << 7 | np.arange(width)
        tree[:, width:] = np.where(np.arange(1, width + 1) < sizes[:, None], first, NONE << 7)
        i = width
        while i > 1:
            tree[:, i // 2:i] = np.minimum(tree[:, i:2 * i:2], tree[:, i + 1:2 * i:2])
            i //= 2
        rows = np.arange(count)
        while len(rows := rows[tree[rows, 1] < NONE << 7]):
            root = tree[rows, 1]
            at, rank = root & 127, root >> 7
            gone = after[rows, at]
            beyond = after[rows, gone]
            tokens[rows, at], tokens[rows, gone], after[rows, at] = rank, -1, beyond
            inside = beyond <= span
            before[rows[inside], beyond[inside]] = at[inside]
            right = tokens[rows, np.minimum(beyond, span)]
            left = before[rows, at]
            has_left, has_right = left >= 0, inside & (right >= 0)
            found = self._rank_of(np.concatenate([
                np.where(has_right, rank << 32 | right, -1),
                np.where(has_left, tokens[rows, np.maximum(left, 0)] << 32 | rank, -1),
            ])).reshape(2, -1)
            # A place without a leaf goes to leaf ``at`` with its value, or to the swallowed leaf, which is none anyway.
            leaf = np.stack([np.where(gone < width, gone, at), np.where(has_left, left, at), at], 1)
            on_at = np.where(at < width, found[0] << 7 | at, NONE << 7)
            value = np.stack([np.where(gone < width, NONE << 7, on_at), np.where(has_left, found[1] << 7 | left, on_at), on_at], 1)
            r = rows[:, None]
            node = leaf + width
            tree[r, node] = np.minimum(value, NONE << 7)
            while node[0, 0] > 1:
                node >>= 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
        kept = tokens >= 0
        packed = tokens[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, pieces: list[bytes]) -> None:
        """Put the ids of all given pieces into the cache."""
        by_width: dict[int, list[bytes]] = {}
        for piece in pieces:
            rank = self.ranks.get(piece)
            if rank is not None:
                self.pieces[piece] = rank.to_bytes(4, "little")
            elif len(piece) > WIDEST + 1:
                self.pieces[piece] = self.merge_one(piece)
            else:
                by_width.setdefault(1 << max(0, (len(piece) - 2).bit_length()), []).append(piece)
        for width, group in by_width.items():
            for start in range(0, len(group), 20_000):
                part = group[start:start + 20_000]
                self.pieces.update(zip(part, self.merge_many(part, width)))

    #: A blank between two characters that aren't white space starts a piece whatever stands before it.
    BETWEEN = re.compile(r"(?<=\S) (?=\S)")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts. Runs between single blanks are encoded apart, as no piece crosses them."""
        split = []
        for text in texts:
            head, *rest = self.BETWEEN.split(text)
            split.append([head, *map(" ".__add__, rest)] if text else [])
        if len(self.runs) > CACHED:
            self.runs, self.old_runs = {}, self.runs
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        runs, old = self.runs, self.old_runs
        missing = []
        for run in {run for part in split for run in part}:
            if run not in runs:
                if run in old:
                    runs[run] = old[run]
                else:
                    missing.append(run)
        pieces = [[p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(run)] for run in missing]
        self.encode_pieces([p for p in dict.fromkeys(p for part in pieces for p in part) if p not in self.pieces])
        ids = self.pieces.__getitem__
        runs.update((run, b"".join(map(ids, part))) for run, part in zip(missing, pieces))
        out = [b"".join(map(runs.__getitem__, part)) for part in split]
        for run in missing:
            if len(run) > LONGEST:
                del runs[run]
        for piece in {p for part in pieces for p in part if len(p) > LONGEST}:
            del self.pieces[piece]
        return out

    def decode(self, packed: bytes | None) -> bytes | None:
        if packed is None or len(packed) % 4:
            return None
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        except KeyError:
            return None


_loaded: dict[tuple[int, str], Bpe] = {}


def loaded(ranks: bytes, pattern: str) -> Bpe:
    """One encoder per worker and vocabulary, kept with its caches from task to task."""
    key = (hash(ranks), pattern)
    if key not in _loaded:
        _loaded[key] = Bpe(ranks, pattern)
    return _loaded[key]


def bpe_encode(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False,
) -> DataFrame:
    """``doc_id, n_tokens long, ids binary`` for every row; ``ids`` are packed little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Repeated rows and null document ids come out as they came in. Other columns
    are not read. There is no shuffle; a worker holds one slice of texts and bounded caches. ``decode`` adds the bytes
    that the ids decode to, as ``decoded``, without a second worker.
    """
    source = id_and_text(df, id_col, text_col)
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks.value, pattern)
        for batch in slices(batches):
            packed = bpe.encode(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
            if decode:
                columns.append(pa.array([bpe.decode(p) for p in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType([source.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    if decode:
        schema = schema.add("decoded", T.BinaryType())
    return source.mapInArrow(encode, schema)


def bpe_decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the bytes of packed ids. Null, ids outside of the vocabulary and broken packing give null.

    A column of that name is replaced; all others are kept.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = loaded(ranks.value, pattern)
        for ids in batches:
            yield pd.Series([bpe.decode(None if p is None else bytes(p)) for p in ids], dtype=object)

    return df.withColumn(out_col, F.pandas_udf(decode, "binary")(F.col(ids_col)))


def unpack_ids(df: DataFrame, ids_col: str = "ids", out_col: str = "id_list") -> DataFrame:
    """Packed ids as ``array<bigint>``, by built-in functions; null has none."""

    def one(i):
        digits = F.hex(F.substring(F.col(ids_col), i * 4 + 1, 4))
        turned = F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)])
        return F.conv(turned, 16, 10).cast("bigint")

    count = (F.coalesce(F.octet_length(ids_col), F.lit(0)) / 4).cast("int")
    return df.withColumn(out_col, F.when(count >= 1, F.transform(F.sequence(F.lit(0), count - 1), one)).otherwise(F.array().cast("array<bigint>")))
