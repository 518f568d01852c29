"""The prefix trie against a plain version, whatever the shards."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from topicloom.llm import prefix_trie
from topicloom.llm.prefix_trie import OUT, Walk, conversation_trie, skeleton_of

SCHEMA = "conv_id long, turn long, role string, text string, path string, base string, step string, shard string, at string"


def plain(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = (*own.get(c - int(math.fmod(c, 100)), [])[:h], *turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node in members:
        below = [n for n in members if n[:len(node)] == node]
        out.append((
            min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]),
            sum(not children[n] for n in below), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "b", "s", "h", "a") for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((tuple(r[c] for c in OUT) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_bytes", [60, 1 << 20])
def test_nodes_agree_with_a_plain_version(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(prefix_trie, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(prefix_trie, "SAMPLE", 2)
    monkeypatch.setattr(prefix_trie, "ENDS", 3)
    rng = random.Random(5)
    rows = []
    for c in range(260):
        if c % 3 == 0:  # a third of all conversations are the same
            turns = [("user", "hello"), ("assistant", "hi 🙂"), ("user", "bye")]
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "日本"])) for _ in range(rng.randint(1, 7))]
        rows += [(c, i if i else rng.choice([None, 0]), *t) for i, t in enumerate(turns)]
    rows += [(1000, i, "user", str(i % 2)) for i in range(300)]
    rows += [(-5, 0, "user", "below zero"), (None, 0, "user", "no conversation"), (None, None, None, None)]
    assert got(conversation_trie(frame(spark, rows))) == plain(rows)


def test_conversations_without_turns_end_at_the_root(spark):
    rows = [(c, 0, "user", "x") for c in (3, 4, 5, 203)]  # without conversation 0, some lose their only turn
    want = plain(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)
    assert got(conversation_trie(frame(spark, rows))) == want


def test_no_conversation_no_node(spark):
    assert conversation_trie(frame(spark, []).limit(0)).count() == 0
    assert conversation_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0


def test_skeleton_nodes_are_left_open():
    a, b = b"a" * 16 + b"\0\0\0\1", b"b" * 16 + b"\0\0\0\2"
    walk = Walk(skeleton_of([(a, 7)]), 0)
    for path, conv_id in ((a, 1), (a, 2), (a + b, 3)):
        walk.add(path, conv_id)
    walk.end()
    assert [(r[0], r[1], r[2]) for r in walk.rows] == [(None, 1, 3), (1, None, 1), (0, None, 1)]
    assert walk.rows[1][-1] == [1, 2]
