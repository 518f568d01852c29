"""Line dedup, the Jaccard join, substring dedup and fingerprints against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from topicloom.llm.fingerprint import (
    as_text, changed, fingerprint, fingerprint_edits, likeness, likeness_of, paragraphs, vector,
)
from topicloom.llm.line_dedup import remove_repeated_lines
from topicloom.llm.set_join import similar_classes
from topicloom.llm.substring_dedup import factors, remove_repeated_passages


def brute_classes(texts, n, percent):
    def of(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) < n:
            return {tuple(words)} if words else set()
        return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}

    sets, up = [of(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), root(i)) for i in range(len(sets))}


def edited(rng, words, times, vocabulary):
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words) + 1)
        words[at:at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
    return words


def test_classes_agree_with_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for size in (0, 1, 2, 3, 5, 11, 12, 14, 18, 22, 25, 30, 40, 60, 150, 400) * 3:
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts += [" ".join(edited(rng, base, k, vocabulary)) for k in [0] + [rng.choice([0, 1, 1, 2, 3, 5]) for _ in range(rng.randint(0, 4))]]
    texts = [t.upper() if rng.random() < 0.2 else t.replace(" ", " \t\n", 1) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for n, percent in ((3, 90), (5, 80)):
        assert {tuple(r) for r in similar_classes(df, n, percent).collect()} == brute_classes(texts, n, percent)


def test_sets_that_lack_nothing_link_with_larger_ones(spark):
    """9 shingles in 10 at 90 percent and 4 in 5 at 80 percent: the smaller set is contained in the larger."""
    for n, percent, sizes in ((3, 90, range(3, 32)), (5, 80, range(5, 24))):
        texts = []
        for size in sizes:
            words = [f"s{size}w{i}" for i in range(size)]
            texts += [" ".join(words), " ".join(["before", *words]), " ".join([*words, "after"])]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        want = brute_classes(texts, n, percent)
        assert {tuple(r) for r in similar_classes(df, n, percent).collect()} == want
        least = {3: 11, 5: 8}[n]
        linked = {texts[i].count(" ") + 1 for i, _, c in want if i != c}
        assert min(linked) == least + 1


def test_a_large_group_of_near_copies_agrees_with_brute_force(spark):
    """Copies that differ from each other by a few edits each: most lists hold many classes after the first stars."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    other = base[:70] + [rng.choice(vocabulary) for _ in range(80)]
    texts = [" ".join(edited(rng, base if i % 3 else other, rng.randint(0, 6), vocabulary)) for i in range(240)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {tuple(r) for r in similar_classes(df, 3, 90).collect()}
    assert got == brute_classes(texts, 3, 90)
    assert len({c for _, _, c in got}) > 20


def test_texts_that_share_a_phrase_alone_are_not_compared(spark, monkeypatch):
    """Keys that a set can do without are left out where they are frequent, and near copies still meet."""
    from topicloom.llm import set_join

    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(50_000)]
    phrase, opened, within = "said in all of these texts and nowhere else".split(), [], set_join._within_hubs
    texts = [[rng.choice(vocabulary) for _ in range(50)] + phrase + [rng.choice(vocabulary) for _ in range(50)] for _ in range(300)]
    texts = [" ".join(t) for t in texts + [edited(rng, t, 2, vocabulary) for t in texts[:20]]]
    monkeypatch.setattr(set_join, "_within_hubs", lambda members, *rest: opened.append(members.count()) or within(members, *rest))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in similar_classes(df, 5, 80).collect()} == brute_classes(texts, 5, 80)
    assert opened == [0]


def test_classes_of_odd_rows(odd, none):
    got = similar_classes(odd, 3, 90).collect()
    assert len(got) == odd.count()
    classes = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert classes[(1, 12)] == classes[(6, 12)] == 1
    assert classes[(2, 0)] == 2 and classes[(3, 0)] == 3 and classes[(4, 0)] == 4 and classes[(9, 4)] == classes[(10, 4)] == 9
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert similar_classes(none).count() == 0


def brute_passages(rows, window):
    first, split = {}, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - window + 1):
            if d is not None:
                first[tuple(words[i:i + window])] = min(first.get(tuple(words[i:i + window]), d), d)
    out = Counter()
    for d, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if d is not None and first[tuple(words[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out[(d, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))] += 1
    return out


def test_passages_agree_with_brute_force(spark, odd, none):
    rng = random.Random(7)
    passages = [[rng.choice("abcé") for _ in range(rng.choice([14, 30, 60]))] for _ in range(8)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.4 else [f"x{rng.randrange(999)}" for _ in range(rng.randint(0, 25))]
        rows.append((rng.choice([i, i, i, max(0, i - 1)]) * 3 - 60, " \n".join(words)))
    rows += [(5000, None), (5001, ""), (None, rows[3][1]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for window in (13, 4):
        got = remove_repeated_passages(df, window).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_passages(rows, window)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    got = remove_repeated_passages(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == brute_passages([(r.doc_id, r.text) for r in odd.collect()], 13)
    assert remove_repeated_passages(none).count() == 0


def test_factors_meet_at_their_boundaries():
    known = np.array([1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1], bool)
    assert factors(known, 3) == [(0, 7), (10, 13)]
    assert factors(np.zeros(4, bool), 3) == []


def brute_lines(rows, passed_over):
    def hashed(line):
        return int(hashlib.md5(line.encode()).hexdigest()[:8], 16)

    chunks, first, out = {}, {}, {}
    for doc, text in rows:
        lines = text.split("\n")
        ends = [i for i in range(len(lines)) if i in (0, len(lines) - 1)
                or (hashed(lines[i - 1]) * 1_000_003 + hashed(lines[i]) >> 13) % passed_over != 0]
        spans = [range(max(a - 1, 0), b + 1) for a, b in zip(ends, ends[1:])]
        chunks[doc] = lines, [s for s in spans if sum(not re.fullmatch(r"[\x20\x09-\x0D]*", lines[i]) for i in s) > 1]
    for doc, (lines, spans) in sorted(chunks.items()):
        for s in spans:
            first.setdefault(tuple(lines[i] for i in s), (doc, s[0]))
    for doc, (lines, spans) in chunks.items():
        gone = {i for s in spans if first[tuple(lines[i] for i in s)] != (doc, s[0]) for i in s}
        out[doc] = len(gone), "\n".join(line for i, line in enumerate(lines) if i not in gone)
    return out


def test_lines_agree_with_a_plain_version(spark):
    rng = random.Random(2)
    blocks = [[f"line {rng.randrange(500)}" for _ in range(rng.randint(2, 20))] for _ in range(6)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(blocks) if rng.random() < 0.5 else [f"own {i} {rng.randrange(9)}" for _ in range(rng.randint(0, 6))]
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.lines_removed, r.text) for r in remove_repeated_lines(df).collect()}
    want = brute_lines(rows, 4)
    assert got == want
    assert sum(n for n, _ in want.values()) > 100


def test_most_lines_of_short_repeated_blocks_go(spark):
    rng = random.Random(3)
    line = lambda: f"line {rng.getrandbits(60)}"
    for size, least in ((3, 0.5), (6, 0.8)):
        rows = []
        for k in range(300):
            block = [line() for _ in range(size)]
            for copy in range(2):
                rows.append((2 * k + copy, "\n".join([*(line() for _ in range(8)), *block, *(line() for _ in range(8))])))
        got = remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        went = {r.doc_id: r.lines_removed for r in got}
        assert not any(n for doc, n in went.items() if doc % 2 == 0)
        assert least * 300 * size <= sum(went.values()) <= 300 * size


def test_lines_that_repeat_without_a_break_and_blank_lines(spark):
    rows = [(1, "\n".join(["x"] * 9)), (2, "\n".join(["a", "b"] * 6)), (3, "p\n\n\n\n\nq"), (4, "r\n\n\n\n\ns"), (5, "\n".join(["x"] * 700))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.lines_removed, r.text) for r in remove_repeated_lines(df).collect()}
    assert got == brute_lines(rows, 4)
    assert got[3] == (0, rows[2][1]) and got[4] == (0, rows[3][1])


def test_a_chunk_of_many_copies_goes_from_all_of_them(spark):
    lines = [f"same {i}" for i in range(6)]
    rows = [(i, "\n".join([f"own {i}", *lines, f"end {i}"])) for i in range(1300)]
    got = {r.doc_id: (r.lines_removed, r.text) for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows, 4) and all(got[i][0] >= 3 for i in range(1, 1300))


def test_lines_of_odd_rows(odd, none):
    got = remove_repeated_lines(odd)
    assert got.columns == [*odd.columns, "lines_removed"]
    rows = {(r.doc_id, r.text) for r in got.collect()}
    assert len(got.collect()) == odd.count()
    assert {(r.doc_id, r.text) for r in odd.collect()} - rows <= {(10, "l1\nl2\nl3\nl4\nl5\nl6")}
    assert all(r.others == "o" and r.n is None and r.lines == "l" for r in got.collect())
    assert remove_repeated_lines(none).count() == 0
    again = remove_repeated_lines(got.withColumn("lines_removed", F.lit("x")))
    assert again.columns == got.columns and again.count() == odd.count()


def test_no_python_runs_in_line_dedup(odd):
    plan = remove_repeated_lines(odd.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_fingerprints_add_up():
    a, b, c = b"first paragraph of text", b"second one", b"third, with some more words in it"
    whole = vector([a, b, c])
    assert np.array_equal(whole, vector([c, a, b]))
    assert np.array_equal(changed(vector([a, b]), inserted=[c]), whole)
    assert np.array_equal(changed(whole, deleted=[b]), vector([a, c]))
    assert not np.array_equal(whole, vector([a, b, c, c]))
    assert likeness_of(whole, whole) == 1.0 and likeness_of(vector([]), whole) == 0.0 and likeness_of(vector([]), vector([])) == 1.0
    many = [b"x%d y%d z%d" % (i, i, i) for i in range(5000)]
    assert np.array_equal(changed(vector(many[:3000]), inserted=many[3000:]), vector(many))


def test_sketch_counts_do_not_wrap_at_16_bits():
    junk = b"same junk line"
    assert likeness_of(vector([junk] * 40_000), vector([junk] * 20_000)) > 0.99
    assert np.array_equal(changed(vector([junk] * 20_000), inserted=[junk] * 20_000), vector([junk] * 40_000))


def plain_edits(rows):
    rows = sorted(((d is not None, d or 0, t or ""), d, t or "") for d, t in rows)
    out = Counter()
    for i, (_, doc, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][2], len(text) // 2
        new = text[:len(text) - half] + after[:half]
        prints = [as_text(vector(paragraphs(t))) for t in (text, new)]
        out[(doc, len(text), hashlib.sha256(new.encode()).hexdigest(), *prints)] += 1
    return out


def test_edits_agree_with_a_plain_version(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, odd, docs.limit(1)):
        got = fingerprint_edits(df).collect()
        want = plain_edits([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    near = fingerprint_edits(docs).agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()[0]
    assert near > 0.9
    assert fingerprint_edits(none).count() == 0


def test_fingerprint_columns(spark):
    df = spark.createDataFrame([("a b c d", "a b c d"), (None, ""), ("a b c", "x y z")], "a string, b string")
    got = df.select(likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("l")).collect()
    assert [r.l for r in got][:2] == [1.0, 1.0] and got[2].l < 0.5
