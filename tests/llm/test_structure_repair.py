"""Repair of conversations against plain versions: a search over all edits, and a table filled row by row."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from topicloom.llm import structure_repair
from topicloom.llm.structure_repair import SYMBOLS, Grammar, Rope, chosen, damaged, learn_grammar, less, repair_conversations, digest_of_turns

SCHEMA = "conv_id long, turn long, role string, text string, string string, audit string, copy string, digest string, place string"
WANTED = re.compile(r"(s?(ua)+)?")
TURNS = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}  # what may follow, by the initial before


def cheapest(string):
    """Least (cost, audit) by a table: after every row, the best for every last initial."""
    def with_insertions(best):
        best = dict(best)
        for _ in range(2):
            for last, (cost, audit) in list(best.items()):
                for new in TURNS[last] - {"s"}:
                    best[new] = min(best.get(new, (10 ** 9, "")), (cost + 3, audit + "I"))
        return best

    best = {"": (0, "")}
    for symbol in string:
        new = {}
        extra = 3 if symbol in "SUAX" else 0
        for last, (cost, audit) in with_insertions(best).items():
            options = [(last, 4, "D")]
            if symbol != "D":
                if symbol.lower() in TURNS[last]:
                    options.append((symbol.lower(), extra, "K"))
                options += [(u, 3 + extra, "R") for u in TURNS[last] - {"s"}]
            for to, more, edit in options:
                new[to] = min(new.get(to, (10 ** 9, "")), (cost + more, audit + edit))
        best = new
    best = with_insertions(best)
    return min(best[x] for x in ("", "a") if x in best)


def searched(string):
    """Least (cost, audit) among all ways to edit a short string with up to two insertions in each gap."""
    best = None
    for edits in product(*[["D"] if s == "D" else ["D", "K", "Ru", "Ra"] for s in string]):
        for gaps in product(["", "u", "a", "ua", "au"], repeat=len(string) + 1):
            initials, audit, cost = gaps[0], "I" * len(gaps[0]), 3 * len(gaps[0])
            for symbol, edit, gap in zip(string, edits, gaps[1:]):
                initials += {"D": "", "K": symbol.lower()}.get(edit, edit[1:]) + gap
                audit += edit[0] + "I" * len(gap)
                cost += {"D": 4, "K": 0}.get(edit, 3) + (3 if edit != "D" and symbol in "SUAX" else 0) + 3 * len(gap)
            if WANTED.fullmatch(initials) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_repair_equals_a_search_over_all_edits():
    grammar = Grammar()
    for n in range(3):
        for string in map("".join, product(SYMBOLS, repeat=n)):
            assert grammar.repair(string) == searched(string) == cheapest(string), string


@pytest.mark.parametrize("rounds", [0, 3, 8])
def test_grammar_gives_the_same(spark, monkeypatch, rounds):
    monkeypatch.setattr(structure_repair, "ROUNDS", rounds)
    monkeypatch.setattr(structure_repair, "LEAST", 2)
    rng = random.Random(7)
    strings = ["".join(rng.choice(SYMBOLS) for _ in range(rng.randint(1, 12))) for _ in range(300)] + ["ua" * 200, "u" * 333, "sD" + "uA" * 150]
    grammar = learn_grammar(spark.createDataFrame([(s, rng.randint(1, 5)) for s in strings], "string string, n long"))
    assert len(grammar.rounds) <= rounds and (rounds == 0 or len(grammar.compressed("ua" * 200)) < 400)
    for string in strings + ["".join(rng.choice(SYMBOLS) for _ in range(rng.randint(0, 60))) for _ in range(200)]:
        assert grammar.repair(string) == cheapest(string), string


def test_ropes_and_pairs():
    rng = random.Random(8)
    def rope(text):
        if len(text) < 2 or rng.random() < 0.2:
            return Rope(text)
        cut = rng.randrange(1, len(text))
        return Rope(rope(text[:cut]), rope(text[cut:]))
    for _ in range(2000):
        a, b = ("".join(rng.choice("DIKR"[:rng.randint(1, 4)]) for _ in range(rng.randint(0, 9))) for _ in range(2))
        x, y = rope(a), rope(b)
        assert str(x) == a and less(x, y) == (a < b)
        assert less(Rope(x, Rope("D")), Rope(x, Rope("K"))) and not less(x, x)
    assert chosen([(1, 2), (2, 3), (4, 4), (1, 5), (4, 1)]) == [(1, 2), (4, 4), (1, 5)]


def plain(rows):
    out = {}
    for conv_id in {r[0] for r in rows if r[0] is not None}:
        after = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0)):
            e = zlib.crc32(f"{conv_id}:{' ' if turn is None else turn}".encode()) % 20
            role, text = (" " if x is None else x for x in (role, text))
            text = "" if e == 1 else re.sub("[.!?]", "", text) if e == 2 else text
            after += [(turn, "user" if e == 4 else role, text)] * (0 if e == 0 else 2 if e == 3 else 1)
        seen, string, counts = set(), "", [0, 0, 0]
        for turn, role, text in after:
            visible = re.findall(r"[^\x20\x09-\x0D]", text)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            fault = 0 if not visible else 1 if (role, text) in seen else 2 if visible[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            string += "D" if fault in (0, 1) else initial.upper() if fault == 2 else initial
        turns = {t for t, _, _ in after if t is not None}
        initials = [role[:1] for _, role, _ in after]
        cost, audit = cheapest(string)
        lines, last, queue = [], "", list(after)
        for edit in audit:
            row = None if edit == "I" else queue.pop(0)
            if edit == "D":
                continue
            role = row[1] if edit == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{row[2] if row else ''}")
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts,
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def test_conversations_agree_with_a_plain_version(spark):
    rng = random.Random(9)
    texts = ["Yes.", "no", "why?", "", " \t\n", None, "a.b!?", "…", "end.  \r\n", " ", "Yes."]
    rows = []
    for c in range(300):
        for turn in rng.sample(range(12), rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]), rng.choice(texts)))
    rows += [(1000, i, "user" if i % 2 else "assistant", f"{i}.") for i in range(700)]
    rows += [(1001, None, "user", "x."), (1002, None, None, None), (None, 1, "user", "x"), (-3, -7, "user", "x."), (-3, 7, "assistant", "y.")]
    df = spark.createDataFrame([(*r, "s", "a", "c", "d", "p") for r in rows], SCHEMA).repartition(3)
    report, turns = repair_conversations(damaged(df))
    digests = {r.conv_id: r.repaired_sha256 for r in digest_of_turns(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv_id, empty))
        for r in report.collect()
    }
    assert got == plain(rows)
    assert any(not v[6] for v in got.values())
    by_conv = {}
    for r in turns.collect():
        by_conv.setdefault(r.conv_id, {})[r.place] = r
    for conv_id, places in by_conv.items():
        assert sorted(places) == list(range(len(places)))
        assert WANTED.fullmatch("".join(places[i].role[0] for i in range(len(places))))


def test_repeated_rows_are_neighbours(spark):
    rows = [(c, 1, "user", "Same.") for c in range(40) for _ in range(3)]
    report, _ = repair_conversations(damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in report.collect()}
    assert {r.conv_id: (r.duplicate, r.cost, r.audit) for r in got.values()} == {c: (p[2], p[5], p[6]) for c, p in plain(rows).items()}


def test_no_rows(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        report, turns = repair_conversations(damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
        assert report.count() == 0 and turns.count() == 0
