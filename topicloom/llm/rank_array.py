"""BPE of a tokenizer file by contiguous rank arrays.

The parts of a word stand in one array, beside it the rank of each part with the next one. A step scans the ranks for
the leftmost least one, deletes the boundary after that part and refreshes the two ranks beside it. Words are short, so
scanning an array beats any tree or heap. Words of up to 32 bytes, nearly all there are, are rows of a matrix, and one
numpy step takes a boundary out of each. The array of a longer word is cut into stretches with their minima, so that a
step scans the minima and then one stretch, and a word of a megabyte without a blank is no trouble.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from topicloom.llm.common import id_and_text, slices
from topicloom.llm.word_ids import read_tokenizer

NONE = 1 << 30  # rank of two parts that don't merge
SHORT = 32  # bytes of a word that is a row of a matrix
ROWS = 4096  # of a matrix
STRETCH = 256  # parts of a long word that are scanned at once
CACHED_BYTES = 24 << 20  # of runs and their ids, as a worker counts them, before the older half is put aside
CACHED_RUN = 64  # characters of a run that is remembered; longer ones hardly come again

#: White space as the tokenizer file cuts it. Fixed values.
BLANKS = "\t-\r \x85\xa0  -     　"
#: Runs that no word crosses: all but white space with a blank before it, and white space as the file cuts it.
RUNS = re.compile(f" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+")


#: How it cuts words. Fixed value.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable letters are their own, the others follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b if b in printable else next(others)): b for b in range(256)}


class RankArrays:
    """Encoder and decoder for a byte-level BPE tokenizer file without normalizer, as the library applies it."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if odd or model.get("ignore_merges") or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"not a plain byte-level BPE file: {odd or 'normalizer, pre-tokenizer or ignore_merges'}")
        if spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("words of this file are cut in another way")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        self.cut = Tokenizer.from_str(file).pre_tokenizer.pre_tokenize_str
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        letters = byte_letters()
        self.tokens = {
            i: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t, i in (vocab | self.added).items()
        }
        self.byte_ids = [vocab.get(letter, -1) for letter in sorted(letters, key=letters.__getitem__)]
        if min(self.byte_ids) < 0:
            raise ValueError("a byte has no token in this file")
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        order = sorted(self.pairs)
        self.pair_keys = np.array([*order, np.iinfo(np.int64).max], np.int64)
        self.pair_ranks = np.array([*map(self.pairs.__getitem__, order), NONE], np.int32)
        self.made_ids = np.array(self.made, np.int32)
        self.letters = np.array(self.byte_ids, np.int32)
        self.byte_pairs = self._ranks(np.repeat(self.letters, 256), np.tile(self.letters, 256)).reshape(256, 256)
        self.runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}
        self.held = 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(NONE))

    def merge_short(self, words: list[bytes], width: int) -> list[bytes]:
        """Packed ids of words of up to ``width`` bytes: each is a row of the matrix of parts and of that of ranks."""
        data = np.frombuffer(b"".join([w.ljust(width + 1, b"\0") for w in words]), np.uint8).reshape(len(words), width + 1)
        place, sizes = np.arange(width + 1), np.fromiter(map(len, words), np.int64, len(words))
        parts = np.where(place < sizes[:, None], self.letters[data], np.int32(-1))
        ranks = np.where(place[1:] < sizes[:, None], self.byte_pairs[data[:, :-1], data[:, 1:]], np.int32(NONE))
        done, rows, each = parts, np.arange(len(words)), np.arange(len(words))
        while len(rows):
            at = ranks.argmin(1)
            least = ranks[each, at]
            going = least < NONE
            if not going.all():
                done[rows] = parts
                rows, parts, ranks, at, least = rows[going], parts[going], ranks[going], at[going], least[going]
                each = np.arange(len(rows))
            # Delete the boundary after ``at``: all that follows moves one place to the left.
            follows = place[:-1] > at[:, None]
            np.copyto(parts[:, :-1], parts[:, 1:].copy(), where=follows)
            parts[:, -1] = -1
            made = parts[each, at] = self.made_ids[least]
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=follows[:, :-1])
            ranks[:, -1] = NONE
            ranks[each, at] = self._ranks(made, parts[each, at + 1])
            some = at > 0
            before = at[some] - 1
            ranks[each[some], before] = self._ranks(parts[each[some], before], made[some])
        kept = done >= 0
        packed = done[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def merge_long(self, word: bytes) -> bytes:
        """Packed ids of one word of any length: its arrays in stretches, with the least rank of each."""
        pairs = self.pairs.get
        step = max(STRETCH, int(len(word) ** 0.5))
        data = np.frombuffer(word, np.uint8)
        all_ranks = np.append(self.byte_pairs[data[:-1], data[1:]], np.int32(NONE))
        parts = [self.letters[data[i:i + step]].tolist() for i in range(0, len(word), step)]
        ranks = [all_ranks[i:i + step].tolist() for i in range(0, len(word), step)]
        least = [min(r) for r in ranks]

        def beside(s: int, i: int) -> None:
            """Refresh the rank of part ``i`` of stretch ``s`` with the part after it, wherever that stands."""
            t, j = s, i + 1
            while t < len(parts) and j == len(parts[t]):
                t, j = t + 1, 0
            ranks[s][i] = pairs(parts[s][i] << 32 | parts[t][j], NONE) if t < len(parts) else NONE

        while (lowest := min(least)) < NONE:
            s = least.index(lowest)
            i = ranks[s].index(lowest)
            parts[s][i] = self.made[lowest]
            t, j = s, i + 1
            while j == len(parts[t]):
                t, j = t + 1, 0
            del parts[t][j], ranks[t][j]
            beside(s, i)
            p, h = s, i - 1
            while h < 0 and p > 0:
                p -= 1
                h = len(parts[p]) - 1
            if h >= 0:
                beside(p, h)
            for touched in {s, t, p}:
                least[touched] = min(ranks[touched], default=NONE)
        return np.array([i for part in parts for i in part], "<u4").tobytes()

    def _words(self, run: str) -> list[str]:
        """The words of a run. Letters that the library's older tables may not know are cut by the library itself."""
        return WORDS.findall(run) if run.isascii() or max(run) < "ɐ" else [run[a:b] for _, (a, b) in self.cut(run)]

    def merge(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of every word."""
        done, by_width = {}, {}
        for word in words:
            data = word.encode()
            if len(data) > SHORT:
                done[word] = self.merge_long(data)
            else:
                by_width.setdefault(len(data) + 3 & ~3, []).append((word, data))
        for width, group in by_width.items():
            for start in range(0, len(group), ROWS):
                part = group[start:start + ROWS]
                done.update(zip([w for w, _ in part], self.merge_short([d for _, d in part], width)))
        return done

    def _find(self, missing: set[str]) -> dict[str, bytes]:
        """Packed ids of runs that are not in the newer half of the cache."""
        old = self.old_runs
        found = {run: old[run] for run in missing if run in old}
        new = [run for run in missing if run not in found]
        words = [self._words(run) for run in new]
        ids = self.merge(list({word for part in words for word in part})).__getitem__
        found.update(zip(new, [b"".join(map(ids, part)) for part in words]))
        return found

    def _runs(self, text: str) -> list[str | int]:
        """The runs of a text, and the ids of added tokens that stand in it as strings."""
        if self.special is None or not self.special.search(text):
            return RUNS.findall(text)
        parts = self.special.split(text)
        return [r for i, part in enumerate(parts) for r in ([self.added[part]] if i % 2 else RUNS.findall(part))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of whole texts. Strings of added tokens are those tokens."""
        split = [self._runs(text or "") for text in texts]
        runs = self.runs
        missing = set().union(*split).difference(runs)
        found = {r: r.to_bytes(4, "little") for r in missing if isinstance(r, int)}
        found.update(self._find(missing - found.keys()))
        runs.update(found)
        out = [b"".join(map(runs.__getitem__, part)) for part in split]
        for r, ids in found.items():
            if isinstance(r, int) or len(r) > CACHED_RUN:
                del runs[r]
            else:
                self.held += 4 * len(r) + len(ids) + 200
        if self.held > CACHED_BYTES // 2:
            self.runs, self.old_runs, self.held = {}, runs, 0
        return out

    def decode(self, packed: bytes | None) -> str | None:
        """The text of packed ids; unknown ids are skipped, broken characters replaced. None and broken packing have none."""
        if packed is None or len(packed) % 4:
            return None
        get = self.tokens.get
        return b"".join([get(i, b"") for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[int, RankArrays] = {}


def loaded(file: str) -> RankArrays:
    """One encoder per worker and file, kept with its cache from task to task."""
    key = hash(file)
    if key not in _loaded:
        _loaded[key] = RankArrays(file)
    return _loaded[key]


def rank_array_encode(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False,
) -> DataFrame:
    """``doc_id, n_tokens long, ids array<int>`` for every row, as the tokenizers library encodes without special tokens.

    Strings of added tokens in a text are those tokens, as in the library. Null and empty texts have no ids. Repeated
    rows and null document ids come out as they came in; an empty table gives no rows; other columns are not read, so
    none can clash. There is no shuffle. A worker holds one slice of texts, at least one whole text, and a cache of at
    most ``CACHED_BYTES``. ``decode`` adds the text that the ids decode to, special tokens included, as ``decoded``.
    """
    source = id_and_text(df, id_col, text_col)
    file = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(file.value)
        for batch in slices(batches):
            packed = coder.encode(batch.column("text").to_pylist())
            counts = np.array([len(p) // 4 for p in packed], np.int64)
            ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(offsets, ids)]
            if decode:
                columns.append(pa.array([coder.decode(p) for p in packed], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType([
        source.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    if decode:
        schema = schema.add("decoded", T.StringType())
    return source.mapInArrow(encode, schema)


def rank_array_decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of id lists. Null has none, unknown and null ids are skipped. A column of that name is replaced."""
    file = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def decode(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = loaded(file.value)
        for ids in lists:
            yield pa.array([
                None if i is None else coder.decode(np.array([x for x in i if x is not None and x >= 0], "<u4").tobytes())
                for i in ids.to_pylist()
            ], pa.string())

    return df.withColumn(out_col, F.arrow_udf(decode, "string")(F.col(ids_col)))
