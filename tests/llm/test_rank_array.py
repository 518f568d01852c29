"""BPE by rank arrays against the library, as it comes: strings of added tokens in a text are those tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topicloom.llm.queries import QUERIES
from topicloom.llm.rank_array import CACHED_BYTES, RankArrays, rank_array_decode, rank_array_encode
from topicloom.llm.word_ids import read_tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    "a", "B", " ", "  ", "é", "é", "\n", "\r\n", "\t", "'s", "'S", "1", "½", "!", "ß", "İ", "Σ", "日本", "🙂", "\x1c", "\x85",
    "<|endoftext|>", "<|endoftext|", "don't", "the ", " the", "　", "\x00", "ǅ", "́", "ﬁ", "՘", "࢏", " ", "​", "\U0001f9ff",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def coder():
    return RankArrays(read_tokenizer(FILE))


def ids_of(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_ids_and_texts_equal_the_library(coder, library):
    rng = random.Random(1)
    texts = ["", "x" * 5000, "aé" * 700, "a" * 32, "a" * 33, "ab" * 33, " " * 200, "12345 " * 300, "日本語" * 800]
    texts += ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (31, 32, 33, 255, 256, 257, 511, 4000)]
    texts += [f"{chr(c)}a {chr(c)}1 {chr(c)}!" for c in range(0x300)]
    for text, packed in zip(texts, coder.encode(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(packed) == ids, text
        assert coder.decode(packed) == library.decode(ids, skip_special_tokens=False) == text


def test_rows_and_stretches_agree(coder):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 16))).encode()[:32] for _ in range(3000)]
    assert coder.merge_short(words, 32) == [coder.merge_long(w) for w in words]


def test_decoding_any_ids(coder, library):
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 20))]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)
    assert coder.decode(None) is None and coder.decode(b"\1") is None and coder.decode(b"\xff" * 4) == ""


def test_cache_is_bounded_in_bytes(coder):
    rng = random.Random(4)
    for _ in range(40):
        coder.encode([" ".join(f"{rng.getrandbits(64):x}" for _ in range(8000)), "字" * 2_000])
        assert coder.held <= CACHED_BYTES and max(map(len, coder.runs), default=0) <= 64


def test_odd_rows(odd, none, library):
    rows = rank_array_encode(odd, FILE, decode=True).collect()
    assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert all(list(r.ids) == library.encode(r.decoded, add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows)
    again = rank_array_decode(rank_array_encode(odd, FILE).withColumnRenamed("n_tokens", "decoded"), FILE).collect()
    assert Counter(r.decoded for r in again) == Counter(r.text or "" for r in odd.collect())
    assert rank_array_encode(none, FILE).count() == 0


def test_query(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op11_rank_array_bpe"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        row = got[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
