"""Ids of a word-level BPE tokenizer file, with the ids of each run between blanks remembered."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import regex
from tokenizers import Tokenizer

CACHED = 200_000  # runs that a worker remembers since it last put its older half aside; as many of those, and of pieces
LONGEST = 64  # bytes of a run or piece that is remembered, so that the caches hold some 100 MB at most

#: How the tokenizer file cuts normalised text. They must equal those of the file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Runs(dict):
    """Ids of each run; those of an unknown one are looked up in the older half, or made. Long ones last for a text."""

    def __init__(self, make: Callable[[bytes], bytes], old: dict[bytes, bytes]):
        super().__init__()
        self.make, self.old, self.long = make, old, {}

    def __missing__(self, run: bytes) -> bytes:
        if len(run) > LONGEST:
            ids = self.long[run] = self.long.get(run) or self.make(run)
        else:
            ids = self[run] = self.old.get(run) or self.make(run)
        return ids


class WordIds:
    """Packed little-endian unsigned 32-bit ids of whole texts.

    The tokenizer drops white space and no piece crosses it, so a run between ASCII white space has the same ids
    wherever it stands. Runs of letters below U+0250 go piece by piece to the model of the tokenizer; any other run
    goes to the tokenizer as it is. So does a run with the string of a special token, which is that token, as for the
    library.
    """

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_str(file)
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, strings)).encode()) if strings else None
        self.model = self.tokenizer.model
        self.pattern = regex.compile(PIECES)
        self.letters = _byte_letters()
        self.ascii = {b: self.letters[b] for b in range(128)}
        self.runs = Runs(self._run, {})
        self.pieces: dict[str, bytes] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isprintable() else "".join([self.letters[b] for b in piece.encode("utf-8")])
        packed = self.packed
        ids = b"".join([packed[t.id] for t in self.model.tokenize(mapped)])
        if len(piece) <= LONGEST:
            self.pieces[piece] = ids
        return ids

    def _run(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "surrogatepass")
        special = self.special is not None and b"<" in run and self.special.search(run) is not None
        if special or not run.isascii():
            if special or max(text) >= "ɐ":
                text = text.encode("utf-8", "replace").decode("utf-8")
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            text = unicodedata.normalize("NFC", text)
        known, text = self.pieces, text.lower()
        if text.isalpha():
            return known.get(text) or self._piece(text)
        if (body := text[:-1]).isalpha() and text[-1] in ".,":
            return (known.get(body) or self._piece(body)) + (known.get(text[-1]) or self._piece(text[-1]))
        return b"".join([known.get(p) or self._piece(p) for p in self.pattern.findall(text)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.runs) > CACHED:
            self.runs = Runs(self._run, dict(self.runs))
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        runs, out = self.runs, []
        for text in texts:
            out.append(b"".join(map(runs.__getitem__, (text or "").encode("utf-8", "surrogatepass").split())))
            runs.long.clear()
        return out


_loaded: dict[int, WordIds] = {}


def loaded(file: str) -> WordIds:
    """One tokenizer per worker and file, kept with its cache from task to task."""
    key = hash(file)
    if key not in _loaded:
        _loaded[key] = WordIds(file)
    return _loaded[key]


def read_tokenizer(path: str) -> str:
    """The tokenizer file, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()
