"""Byte-level BPE, packing and shards against the libraries and exact round trips."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from topicloom.llm.bpe import Bpe, bpe_decode, bpe_encode, read_ranks, unpack_ids
from topicloom.llm.packing import cut_lengths, harmonic_pack, sequences
from topicloom.llm.shards import in_shards, permuted, read_sequence, token_sequences, write_shards
from topicloom.llm.word_ids import Runs, WordIds, read_tokenizer

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = [
    "a", "B", " ", "  ", "é", "é", "\n", "\r\n", "\t", "'s", "'S", "1", "½", "!", "ß", "İ", "Σ", "日本", "🙂", " ", " ", "\x1c",
    "\x85", "<|endoftext|>", "don't", "the ", " the", "　", "\x00", "ǅ", "́", "ﬁ",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    fixed = ["", "x" * 5000, "aé" * 700, "a" * 65, "a" * 66, "ab" * 33, " " * 200, "12345 " * 300]
    return fixed + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(1500)]


def test_bpe_equals_the_library(texts):
    bpe = Bpe(read_ranks(RANKS), PATTERN)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for text, packed in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text), text
        assert bpe.decode(packed) == text.encode()
    assert bpe.decode(None) is None and bpe.decode(b"\1") is None and bpe.decode(b"\xff" * 4) is None
    for piece in (b"ab", b"the quick", b"hello world " * 30, "日本語".encode() * 9):  # the tree alone and the trees side by side
        if len(piece) <= 65:
            width = 1 << max(0, (len(piece) - 2).bit_length())
            assert bpe.merge_one(piece) == bpe.merge_many([piece], width)[0]
        assert bpe.decode(bpe.merge_one(piece)) == piece


def test_bpe_on_odd_rows(odd, none):
    coded = bpe_decode(bpe_encode(odd, RANKS, PATTERN, decode=True).withColumnRenamed("decoded", "first"), RANKS, PATTERN)
    got = unpack_ids(coded).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in got) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert all(r.first == r.decoded and r.n_tokens == len(r.id_list) == len(r.ids) // 4 for r in got)
    assert all(r.id_list == np.frombuffer(r.ids, "<u4").tolist() for r in got)
    assert bpe_encode(none, RANKS, PATTERN).count() == 0


def test_word_ids_equal_the_library(texts):
    library = Tokenizer.from_file(WORDS)
    texts = [*texts, "a <|endoftext|> b", "x<|startoftext|>y<|endoftext|><|endoftext|", "é<|ENDOFTEXT|>日"]
    words = WordIds(read_tokenizer(WORDS))
    for text, packed in zip(texts, words.encode(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert words.encode([None]) == [b""]


def test_caches_forget_long_runs():
    bpe, words, rng = Bpe(read_ranks(RANKS), PATTERN), WordIds(read_tokenizer(WORDS)), random.Random(2)
    for _ in range(20):
        text = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(3000)) + " " + "x" * 100 + " short"
        bpe.encode([text])
        words.encode([text])
    assert max(map(len, bpe.runs)) <= 64 and max(map(len, bpe.pieces)) <= 64
    assert max(map(len, words.runs)) <= 64 and max(map(len, words.pieces)) <= 64


def test_cuts_leave_little_padding():
    for tokens in (1, 2, 31, 33, 700, 1023, 1025, 1500, 2047, 2048, 2049, 9000):
        cuts = cut_lengths(tokens, 2048, 32)
        assert sum(n for n, _ in cuts) == tokens
        assert all(n * k <= 2048 and 2048 - n * k <= 32 for n, k in cuts)


def check_packing(pieces, want, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, bytes(p.ids), p.doc_tokens))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        padding += 0 if at & at - 1 == 0 else capacity - at
    assert by_doc.keys() == want.keys()
    for doc, parts in by_doc.items():
        assert b"".join(ids for _, ids, _ in sorted(parts)) == want[doc]
        assert {t for _, _, t in parts} == {len(want[doc]) // 4}
    return padding / sum(len(v) // 4 for v in want.values())


def test_packing_holds_every_id_once(spark, odd, none):
    words = WordIds(read_tokenizer(WORDS))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: words.encode([r.text])[0] + b"\1\0\0\0" for r in docs.collect()}
    pieces = harmonic_pack(docs, WORDS, end_id=1)
    assert check_packing(pieces.collect(), want, 2048) < 0.02
    whole = sequences(pieces).collect()
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole)
    assert sum(r.n_pieces for r in whole) == pieces.count()
    assert check_packing(harmonic_pack(docs, WORDS, end_id=1, capacity=64, slack=2).collect(), want, 64) < 0.1
    got = harmonic_pack(odd, WORDS, end_id=1).collect()
    assert sum(r.length for r in got) == sum(len(words.encode([r.text])[0]) // 4 + 1 for r in odd.collect())
    assert harmonic_pack(none, WORDS, end_id=1).count() == 0


def test_permutation_is_one_and_turns_back():
    for count in (1, 2, 3, 17, 1000, 4097):
        places = permuted(np.arange(count), count, 5)
        assert sorted(places.tolist()) == list(range(count))
        assert (permuted(places, count, 5, back=True) == np.arange(count)).all()
    assert (permuted(np.arange(1000), 1000, 1) != permuted(np.arange(1000), 1000, 2)).any()


def test_shards_give_every_sequence_at_its_slot(spark, tmp_path, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    placed = token_sequences(docs, WORDS, end_id=49407, key=11, length=128)
    rows = placed.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    path = str(tmp_path / "shards")
    made = write_shards(placed, path, per_shard=50, length=128).collect()
    assert sum(r.n_sequences for r in made) == len(rows) and len(made) == -(-len(rows) // 50)
    for r in rows[:100]:
        record = read_sequence(path, r.slot, 50, length=128)
        assert record[:r.n_tokens].tobytes() == bytes(r.tokens) and not record[r.n_tokens:].any()
    words, by_doc = WordIds(read_tokenizer(WORDS)), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.part, bytes(r.tokens)))
    for r in docs.collect():
        ids = np.frombuffer(words.encode([r.text])[0], "<u4").tolist() + [49407]
        assert np.frombuffer(b"".join(t for _, t in sorted(by_doc[r.doc_id])), "<u2").tolist() == ids
    records = in_shards(placed, 50, 128).collect()
    assert all(r.shard == r.slot // 50 and r.record == r.slot % 50 and len(r.bytes) == 256 for r in records)
    slots = sorted(r.slot for r in token_sequences(odd, WORDS, end_id=49407, key=1).collect())
    assert slots == list(range(len(slots))) and len(slots) >= odd.count()
    assert token_sequences(none, WORDS, end_id=49407, key=1).count() == 0
    with pytest.raises(ValueError):
        token_sequences(none, WORDS, end_id=1 << 16, key=1)


def test_crc_of_packed_ids(spark):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(bytearray(b"\1\0\0\0"),)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(b"\1\0\0\0")


def test_runs_are_made_once_and_long_ones_last_for_a_text():
    made = []
    runs = Runs(lambda run: made.append(run) or run * 2, {b"old": b"known"})
    long = b"x" * 65
    assert [runs[r] for r in (b"old", b"new", b"new", long, long)] == [b"known", b"newnew", b"newnew", long * 2, long * 2]
    assert made == [b"new", long] and set(runs) == {b"old", b"new"}
    runs.long.clear()
    assert runs[long] == long * 2 and made == [b"new", long, long]
