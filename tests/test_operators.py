import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom import sinks, sources
from topicloom.operators import aggregates as a
from topicloom.operators import joins as j
from topicloom.operators import topk as k
from topicloom.operators import classify
from topicloom.operators.classify import classify_topics, vocabulary
from topicloom.operators.encode import embed
from topicloom.operators.fuzzy import fuzzy_match, windows
from topicloom.operators import linking
from topicloom.operators.linking import link_topics
from topicloom.operators.people import author_affiliations, paper_authors
from topicloom.operators.upsert import upsert_edges, upsert_nodes
from topicloom.schemas import POSTS_XML, TRIPLES


def test_denormalize_repeats_a_posting_per_industry(spark, rows):
    jobs = spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, title string")
    links = spark.createDataFrame([(1, 10), (1, 11), (3, 10)], "job_id long, industry_id long")
    industries = spark.createDataFrame([(10, "IT"), (11, "Law")], "industry_id long, industry_name string")
    got = j.denormalize_jobs(jobs, links, industries).select("job_id", "industry_name")
    assert rows(got) == [(1, "IT"), (1, "Law")]


def test_runs_go_on_over_batches():
    rows = [(None, "x", "a"), (None, "y", "b"), (1, None, "c"), (2, "z", "d"), (2, "z", "e"), (2, "w", "f"), (3, "u", "g")]
    table = pa.table({name: [r[i] for r in rows] for i, name in enumerate("kvw")}, schema=pa.schema([("k", pa.int64()), ("v", pa.string()), ("w", pa.string())]))
    want = [(None, "xy", "ab"), (1, "", "c"), (2, "zzw", "def"), (3, "u", "g")]
    for size in range(1, 8):
        got = [tuple(r.values()) for batch in a.joined_runs(table.to_batches(max_chunksize=size)) for r in batch.to_pylist()]
        assert got == want, size
    assert list(a.joined_runs([])) == []


def test_presence_joins(spark, rows):
    topics = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    e1 = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "src long, dst string")
    e2 = spark.createDataFrame([(1, "a")], "src long, dst string")
    assert rows(j.present_in_all(topics, e1, e2)) == [("a",)]
    assert rows(j.only_in(topics, e1, e2)) == [("b",)]
    assert rows(j.topic_counts(topics, x=e1, y=e2)) == [("a", 2, 1), ("b", 1, 0), ("c", 0, 0)]
    up = spark.createDataFrame([("a", "r"), ("a", "s")], "src string, dst string")
    assert j.papers_with_subtopic(e1, up).count() == 4
    assert j.papers_with_subtopic(e1, up, per_parent=False).count() == 2


def test_collected_values_are_one_row_per_key(spark):
    df = spark.range(50_000).selectExpr("'hot' AS k", "CAST(id % 25000 AS INT) AS v").union(
        spark.createDataFrame([("cold", 1), ("cold", None)], "k string, v int"))
    got = {r.k: list(r["values"]) for r in a.collect_distinct_by(df, "k", "v").collect()}
    assert a.collect_distinct_by(df, "k", "v").count() == 2
    assert got == {"hot": list(range(25_000)), "cold": [1]}
    assert a.distinct_by(df, "k", "v").count() == 25_001


def test_last_per_key(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert rows(a.last_per_key(df, "k", "o")) == [("a", "z"), ("b", None)]


def test_top_k_ties_go_by_the_last_column(spark, rows):
    df = spark.createDataFrame([("a", 1.0, "z"), ("a", 1.0, "x"), ("a", 2.0, "y"), ("a", 1.0, "w")], "k string, s double, t string")
    got = k.top_k_per_key(df, "k", [F.desc("s"), "t"], 3)
    assert [r[2] for r in sorted(got.collect(), key=lambda r: r["rank"])] == ["y", "w", "x"]


def test_limit_per_file(spark, tmp_path, rows):
    for name, n in (("a", 30), ("b", 5)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{name}{i}\n" for i in range(n)))
    df = sources.read_csv_tree(spark, str(tmp_path), names=["v"], multiline=False, with_source=True)
    got = {r.v for r in k.limit_per_file(df, 10).collect()}
    assert got == {f"a{i}" for i in range(10)} | {f"b{i}" for i in range(5)}


def test_upserts(spark, rows):
    old = spark.createDataFrame([(1, "a", "keep"), (2, "b", "keep")], "id long, name string, only_old string")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 6), (3, "c", 6), (None, "x", 1)], "id long, name string, extra int")
    once = upsert_nodes(old, new, "id")
    want = [(1, "a", "keep", None), (2, "b", "keep", 5), (3, "c", None, 6)]
    assert rows(once) == want
    assert rows(upsert_nodes(once, new, "id")) == want
    src = spark.createDataFrame([(1,), (2,)], "id long")
    dst = spark.createDataFrame([("t",)], "name string")
    edges = spark.createDataFrame([(1, "t", 0.5), (1, "t", 0.9), (9, "t", 1.0), (2, "gone", 1.0)], "src long, dst string, w double")
    kept = upsert_edges(None, edges, src, dst, props=["w"])
    assert rows(kept) == [(1, "t", 0.9)]
    assert rows(upsert_edges(kept, edges.where("w = 0.5"), src, dst, props=["w"])) == [(1, "t", 0.5)]


def test_upsert_takes_whole_rows(spark, rows):
    new = spark.createDataFrame([(1, "zeta", 2001, "a"), (1, "alpha", 2020, "b")], "id long, name string, year int, tag string")
    assert rows(upsert_nodes(None, new, "id").select("id", "name", "year", "tag")) == [(1, "zeta", 2001, "a")]
    latest = upsert_nodes(None, new.withColumn("at", new["year"]), "id", order="at")
    assert rows(latest.select("id", "name", "year", "tag")) == [(1, "alpha", 2020, "b")]


def test_long_phrases_are_found(spark):
    topics = spark.createDataFrame([("very_long_topic_name_indeed",)], "name string")
    papers = spark.createDataFrame([(1, "a very long topic name indeed", None, None)], "eid long, title string, abstract string, keywords string")
    up = spark.createDataFrame([], "src string, dst string")
    assert [r.topic for r in classify_topics(papers, vocabulary(topics), up).collect()] == ["very_long_topic_name_indeed"]


def test_automaton_and_join_find_the_same(spark, rows, monkeypatch):
    rng = random.Random(8)
    phrases = ["_".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    vocab = spark.createDataFrame([(p, f"t{i % 9}") for i, p in enumerate(phrases)], "phrase string, topic string").distinct()
    up = spark.createDataFrame([(f"t{i}", f"t{i % 4}") for i in range(9)], "src string, dst string")
    texts = [(i, " ".join(rng.choice(["a", "b", "c", "C,", "ab", "é"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    papers = spark.createDataFrame([*texts, (None, "a b"), (99, None)], "eid long, title string")
    for n_max in (None, 2):
        options = {"text_cols": ["title"], "k": None, "n_max": n_max}
        walked = rows(classify_topics(papers, vocab, up, **options).select("eid", "topic", "score"))
        monkeypatch.setattr(classify, "FEW_PHRASES", 0)
        assert walked and walked == rows(classify_topics(papers, vocab, up, **options).select("eid", "topic", "score"))
        monkeypatch.undo()
    assert classify_topics(papers, vocab.limit(0), up, text_cols=["title"]).count() == 0


@pytest.mark.parametrize("few", [200_000, 0])
def test_classify_near_spellings(spark, rows, monkeypatch, few):
    """Held against every run of words compared with every phrase, word by word."""
    monkeypatch.setattr(classify, "FEW_PHRASES", few)
    names = ["neural networks", "neural network", "knowledge graph", "ontology", "ontologies", "rank", "Zürichberg"]
    texts = ["Neurl networks and neural networcs", "neural network", "knowlege graph of knowledge grap", "ontologie, ontologyy ontology",
             "ranc", "zurichberg zürichbergs", "knowledge-graphs knowledges graph", "", None, "neurall netwroks", "ontolog ontologys"]
    topics = spark.createDataFrame([(n,) for n in names], "name string")
    papers = spark.createDataFrame(list(enumerate(texts)), "eid long, title string")
    up = spark.createDataFrame([("ontology", "root")], "src string, dst string")

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            line, above = [i], line
            for j_, y in enumerate(b, 1):
                line.append(min(above[j_] + 1, line[-1] + 1, above[j_ - 1] + (x != y)))
        return line[-1]

    phrases = {n: n.lower().split() for n in names}
    stated = {w for ws in phrases.values() for w in ws}

    def same(run, phrase):
        off = [(x, y) for x, y in zip(run, phrase) if x != y]
        return len(run) == len(phrase) and (not off or len(off) == 1 and len(off[0][1]) >= 8 and off[0][0] not in stated and edits(*off[0]) <= 1)

    want = {}
    for eid, text in enumerate(texts):
        words = "".join(x if x.isalnum() else " " for x in (text or "").lower()).split()
        for name, phrase in phrases.items():
            times = sum(same(words[i:i + len(phrase)], phrase) for i in range(len(words)))
            for topic in [name] + ["root"] * (name == "ontology"):
                if times:
                    want[eid, topic] = want.get((eid, topic), 0) + times
    found = classify_topics(papers, vocabulary(topics), up, k=None, text_cols=["title"], near=1)
    assert {(r.eid, r.topic): r.score for r in found.collect()} == want and len(want) >= 10


def test_people(spark, rows):
    papers = spark.createDataFrame(
        [(1, "Smith J.; Doe A.;", "Smith J., Univ X, City; NoComma; , x; Doe A., Lab"), (2, None, None)],
        "eid long, authors string, authors_with_affiliations string")
    assert rows(paper_authors(papers)) == [("Doe A.", 1), ("Smith J.", 1)]
    assert rows(author_affiliations(papers)) == [("Doe A.", "Lab"), ("Smith J.", "Univ X, City")]


def test_classification(spark):
    topics = spark.createDataFrame([("machine_learning",), ("graphs",)], "name string")
    synonyms = spark.createDataFrame([("ML", "machine_learning")], "synonym string, topic string")
    up = spark.createDataFrame([("machine_learning", "ai"), ("graphs", "math"), ("graphs", "ai")], "src string, dst string")
    papers = spark.createDataFrame(
        [(1, "Machine learning on graphs", "ML and machine-learning", None), (2, None, None, None)],
        "eid long, title string, abstract string, keywords string")
    vocab = vocabulary(topics, synonyms)
    got = [(r.eid, r.topic, r.score) for r in classify_topics(papers, vocab, up).orderBy("rank").collect()]
    assert got == [(1, "ai", 4), (1, "machine_learning", 3), (1, "graphs", 1), (1, "math", 1)]
    above = classify_topics(papers, vocab, up, include_direct=False).orderBy("rank").collect()
    assert [r.topic for r in above] == ["ai", "math"]


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, cx in enumerate(x, 1):
        last, row[0] = row[0], i
        for jx, cy in enumerate(y, 1):
            last, row[jx] = row[jx], min(row[jx] + 1, row[jx - 1] + 1, last + (cx != cy))
    return row[-1]


def test_fuzzy_match_finds_all_pairs(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(0, 6))) for _ in range(120)}
    names = {"".join(rng.choice("abcé") for _ in range(rng.randint(0, 6))) for _ in range(60)}
    left = spark.createDataFrame([(w,) for w in words], "keyword string")
    right = spark.createDataFrame([(w,) for w in names], "name string")
    for limit in (1, 2):
        got = {tuple(r) for r in fuzzy_match(left, right, limit).collect()}
        assert got == {(w, n, distance(w, n)) for w in words for n in names if distance(w, n) <= limit}


def test_fuzzy_match_of_long_texts(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(30, 60))) for _ in range(40)] + [None, ""]
    words = [None, "", "ab"]
    for name in names[:40]:
        for edits in range(5):
            word = list(name)
            for _ in range(edits):
                at = rng.randrange(len(word))
                word[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            words.append("".join(word))
    left = spark.createDataFrame([(w,) for w in words], "keyword string")
    right = spark.createDataFrame([(n,) for n in names], "name string")
    pairs = {(w, n, distance(w, n)) for w in words for n in names if None not in (w, n) and abs(len(w) - len(n)) <= 3}
    for limit in (2, 3):
        got = {tuple(r) for r in fuzzy_match(left, right, limit).collect()}
        assert got == {p for p in pairs if p[2] <= limit}
    entries = left.where("length(keyword) > 30").select(F.size(windows(F.col("keyword"), 3)).alias("n"))
    assert entries.agg(F.max("n")).first()[0] <= 7 * 4 * 7


def brute_links(entities, topics, threshold, top):
    best = {}
    for (key, x), (name, y) in itertools.product(entities, topics):
        if len(x) != 8 or not np.any(x) or not np.any(y):
            continue
        x8 = np.array(x)
        sim = float(x8 @ y / np.linalg.norm(x8) / np.linalg.norm(y))
        if sim >= threshold:
            best[key, name] = max(sim, best.get((key, name), -1))
    out = set()
    for key in {k for k, _ in best}:
        ranked = sorted(((-s, n) for (k2, n), s in best.items() if k2 == key))[:top]
        out |= {(key, n, round(-s, 9)) for s, n in ranked}
    return out


def test_equal_vectors_are_written_once(spark, monkeypatch):
    written, stored = {}, linking.stored

    def counted(df, name="step"):
        out = stored(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(linking, "stored", counted)
    left = spark.createDataFrame([("often", [1.0, 0.0])] * 50 + [("other", [1.0, 1.0])], "id string, embedding array<double>")
    right = spark.createDataFrame([("x", [1.0, 0.0])] * 20 + [("y", [0.0, 1.0])], "topic string, embedding array<double>")
    got = link_topics(left, right, threshold=0.5, k=2, dim=2).collect()
    assert {(r.id, r.topic) for r in got} == {("often", "x"), ("other", "x"), ("other", "y")} and len(got) == 3
    assert written["vectors"] == [2, 2]


def test_linking_agrees_with_brute_force_in_any_blocks(spark):
    rng = np.random.default_rng(1)
    entities = [(f"e{i % 40}", rng.normal(size=8).tolist()) for i in range(60)]
    entities += [("zero", [0.0] * 8), ("short", [1.0, 2.0]), ("long", [1.0] * 9)] + [("hot", [1.0] * 8)] * 50
    topics = [(f"t{i % 20}", rng.normal(size=8)) for i in range(60)] + [("often", np.arange(8) + i / 10) for i in range(9)] + [("copy_a", np.ones(8)), ("copy_b", np.ones(8)), ("none", np.zeros(8))]
    left = spark.createDataFrame(entities, "id string, embedding array<double>")
    right = spark.createDataFrame([(n, v.tolist()) for n, v in topics], "topic string, embedding array<double>")
    want = brute_links(entities, topics, 0.2, 3)
    for bound in (None, 5):
        got = link_topics(left, right, threshold=0.2, k=3, dim=8, max_topics=bound)
        assert {(r.id, r.topic, round(r.cosine_similarity, 9)) for r in got.collect()} == want


def test_linking_takes_no_vectors_to_the_driver(spark, monkeypatch):
    """A topic of more vectors than a block holds is dealt into blocks; nothing but a bounded sample is collected."""
    rng = np.random.default_rng(4)
    entities = [(f"e{i}", rng.normal(size=8).tolist()) for i in range(30)]
    topics = [("hot", rng.normal(size=8)) for _ in range(40)] + [(f"t{i}", rng.normal(size=8)) for i in range(6)]
    left = spark.createDataFrame(entities, "id string, embedding array<double>")
    right = spark.createDataFrame([(n, v.tolist()) for n, v in topics], "topic string, embedding array<double>")

    def refuse(*args, **options):
        raise AssertionError("vectors went to the driver")

    with monkeypatch.context() as patch:
        for frame in {type(left), DataFrame}:
            patch.setattr(frame, "toPandas", refuse)
        patch.setattr(type(spark.sparkContext), "broadcast", refuse)
        links = link_topics(left, right, threshold=0.2, k=3, dim=8, max_topics=5)
    got = {(r.id, r.topic, round(r.cosine_similarity, 9)) for r in links.collect()}
    assert got == brute_links(entities, topics, 0.2, 3)


@pytest.mark.parametrize("bound", [None, 40])
def test_linking_skips_cells_that_cannot_win(spark, bound):
    """Equal to brute force on clustered vectors, with less than 30% of the pairs multiplied."""
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(12, 8))
    near = lambda i: (middles[i % 12] + rng.normal(size=8) * 0.1).tolist()
    entities = [(f"e{i}", near(i)) for i in range(150)]
    topics = [(f"t{i % 200}", near(i % 200)) for i in range(400)]
    left = spark.createDataFrame(entities, "id string, embedding array<double>")
    right = spark.createDataFrame(topics, "topic string, embedding array<double>")
    compared = spark.sparkContext.accumulator(0)
    got = link_topics(left, right, threshold=0.3, k=5, dim=8, max_topics=bound, compared=compared)
    rows = {(r.id, r.topic, round(r.cosine_similarity, 9)) for r in got.collect()}
    assert rows == brute_links(entities, [(n, np.array(v)) for n, v in topics], 0.3, 5)
    assert 0 < compared.value < 0.3 * len(entities) * len(topics)


def test_linking_of_vectors_without_a_direction(spark):
    odd = [("zero", [0.0] * 3), ("nan", [float("nan"), 1.0, 1.0]), ("inf", [float("inf"), 1.0, 1.0]), ("none", None), ("hole", [None, 1.0, 1.0]), (None, [1.0] * 3)]
    good = [("a", [1.0, 0.0, 0.0]), ("b", [-1.0, 0.0, 0.0])]
    of = lambda data, name: spark.createDataFrame(data, f"{name} string, embedding array<double>")
    run = lambda e, t: sorted((r.id, r.topic) for r in link_topics(of(e, "id"), of(t, "topic"), threshold=-1.0, k=2, dim=3).collect())
    assert run(odd + good, odd + good) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]
    assert run(good, odd) == run(odd, good) == run(good, []) == run([], good) == []


def test_linking_encodes_every_row_once(spark):
    for bound in (None, 4):
        counted = spark.sparkContext.accumulator(0)

        def encoder():
            def encode(texts):
                counted.add(len(texts))
                return np.array([[len(t), t.count("a"), 1] for t in texts], dtype=float)

            return encode

        entities = embed(spark.range(100).selectExpr("id", "repeat('ab', CAST(id % 7 AS INT)) AS t"), "t", encoder=encoder)
        topics = embed(spark.range(12).selectExpr("'t' || id AS topic", "repeat('a', CAST(id AS INT)) AS t"), "t", encoder=encoder)
        assert link_topics(entities, topics, threshold=0.0, k=3, dim=3, max_topics=bound).count() == 300
        assert counted.value == 112


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.embedding for r in embed(df, "t", dim=16).collect()}
    assert abs(np.linalg.norm(got[1]) - 1) < 1e-6
    assert not np.any(got[2]) and not np.any(got[3])

    def lengths():
        return lambda texts: np.array([[len(x), 1] for x in texts], dtype=float)

    assert [list(r.embedding) for r in embed(df, "t", encoder=lengths).orderBy("id").collect()] == [[5, 1], [0, 1], [0, 1]]


def test_csv_round_trip(spark, tmp_path, rows):
    data = [(1, 'say "hi", now\nnext line'), (2, " padded "), (3, "plain")]
    df = spark.createDataFrame(data, "id int, t string")
    sinks.write_csv(df, str(tmp_path / "x" / "y"))
    assert rows(sources.read_csv_tree(spark, str(tmp_path / "x"), schema=df.schema)) == sorted(data, key=repr)


@pytest.mark.parametrize("most_blocks", [100_000, 1])
def test_csv_in_splits_of_any_size(spark, tmp_path, rows, monkeypatch, most_blocks):
    """Records across many small splits are those of the reader that takes a file whole, in either way to order lines."""
    monkeypatch.setattr(sources.readers, "MOST_BLOCKS", most_blocks)
    rng = random.Random(9)
    bits = ["word", '"', '""', "\n", "\n\n", ",", " x ", "ü", "\r\n", "a,b"]
    data = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) + "e", "k") for i in range(400)]
    data += [(400, "long\n" * 400 + "e", "k"), (401, 'q"\n' * 300 + "e", "k")]
    schema = "id int, t string, k string"
    df = spark.createDataFrame(data, schema)
    sinks.write_csv(df.coalesce(2), str(tmp_path / "x"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("97", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = sources.read_csv_in_splits(spark, str(tmp_path / "x"), df.schema)
            assert rows(got) == sorted(data, key=repr)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_csv_in_splits_of_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\r\n1,"x\r\ny"\r\n\r\n2,plain\r\nbad,z\r\n')
    (tmp_path / "b.csv").write_text("id,t\n")
    (tmp_path / "c.csv").write_text("")
    schema = spark.createDataFrame([], "id int, t string").schema
    read = lambda how: [tuple(r) for r in sources.read_csv_in_splits(spark, str(tmp_path), schema, bad_rows=how).orderBy("id").collect()]
    assert read("drop") == [(1, "x\r\ny"), (2, "plain")]
    assert read("null") == [(None, "z"), (1, "x\r\ny"), (2, "plain")]
    assert read("keep")[0][-1] == "bad,z"


def test_triples_skip_other_widths(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,p,b\nonly,two\nw,x,y,z\n c , q , d \n")
    got = sources.read_triples(spark, str(path))
    assert sorted(r.subj for r in got.select("subj").collect()) == ["a", "c"]
    _, bad = sources.split_bad_rows(sources.read_csv(spark, str(path), schema=TRIPLES, names=TRIPLES.names, bad_rows="keep"))
    assert sorted(r[0] for r in bad.collect()) == ["only,two", "w,x,y,z"]


def test_xml_rows(spark, tmp_path):
    path = tmp_path / "p.xml"
    path.write_text('<posts><row Id="1" PostTypeId="1" CreationDate="2012-05-01T10:00:00.000" Body="&lt;p&gt;x&lt;/p&gt;" Tags="&lt;a&gt;"/>'
                    '<row Id="2" PostTypeId="2"/></posts>')
    got = sources.read_xml_rows(spark, str(path), "row", POSTS_XML).orderBy("_Id").collect()
    assert (got[0]["_Body"], got[0]["_Tags"], got[0]["_CreationDate"].year, got[1]["_Body"]) == ("<p>x</p>", "<a>", 2012, None)


def test_xml_in_splits_equals_whole_files(spark, tmp_path):
    path = tmp_path / "many.xml"
    rows_ = "".join(f'  <row Id="{i}" PostTypeId="1" Body="&lt;b&gt;{i}&lt;/b&gt;" />\n' for i in range(9000))
    path.write_text(f'<?xml version="1.0" encoding="utf-8"?>\n<posts>\n{rows_}</posts>\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        split = sources.read_xml_rows(spark, str(path), "row", POSTS_XML, one_per_line=True)
        assert split.rdd.getNumPartitions() > 5
        whole = sources.read_xml_rows(spark, str(path), "row", POSTS_XML)
        assert split.exceptAll(whole).isEmpty() and split.count() == whole.count() == 9000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_hierarchy_documents(spark, tmp_path, rows):
    edges = spark.createDataFrame([("r", f"c{i}") for i in range(30)] + [("c1", "d")], "parent string, child string")
    sinks.write_hierarchy(edges, str(tmp_path / "lines"))
    assert rows(sources.read_hierarchy(spark, str(tmp_path / "lines"))) == rows(edges)
    (tmp_path / "one.json").write_text('{\n "a": ["b",\n "c"],\n "b": []\n}')
    assert rows(sources.read_hierarchy(spark, str(tmp_path / "one.json"), single_document=True)) == [("a", "b"), ("a", "c")]


def test_upsert_parquet(spark, tmp_path, rows):
    path = str(tmp_path / "nodes")
    spark.createDataFrame([(1, "a")], "id long, n string").write.parquet(path)
    new = spark.createDataFrame([(1, "b"), (2, "c")], "id long, n string")
    for _ in range(2):
        assert rows(sinks.upsert_parquet(spark, path, lambda old: upsert_nodes(old, new, "id"))) == [(1, "b"), (2, "c")]


def stored_files(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_upsert_buckets_rewrites_touched_buckets_only(spark, tmp_path, rows):
    path = tmp_path / "nodes"
    nodes = spark.range(1000).select("id", F.concat(F.lit("n"), "id").alias("n"))
    sinks.upsert_buckets(nodes, str(path), ["id"], buckets=16)
    first = stored_files(path)
    planned = sinks.read_buckets(spark, str(path))  # a reader that looked before the upsert
    new = spark.createDataFrame([(5, "five"), (5, "fife"), (1001, "x"), (None, "lost")], "id int, n string")
    want = sorted([(i, f"n{i}") for i in range(1000) if i != 5] + [(5, "five"), (1001, "x")], key=repr)
    assert rows(sinks.upsert_buckets(new, str(path), ["id"], buckets=99)) == want
    assert planned.count() == 1000
    second = stored_files(path)
    assert set(first.items()) <= set(second.items()) and 1 <= len(second) - len(first) <= 2
    for _ in range(2):
        assert rows(sinks.upsert_buckets(new, str(path), ["id"])) == want
    assert len(stored_files(path)) == len(second)
    assert rows(sinks.upsert_buckets(new.limit(0), str(path), ["id"])) == want
    assert not list(path.glob("_staged*"))


def test_upsert_buckets_goes_on_after_a_stop(spark, tmp_path, rows):
    path = tmp_path / "edges"
    edges = spark.createDataFrame([(s, d, 0.5) for s in range(20) for d in "abc"], "src long, dst string, w double")
    sinks.upsert_buckets(edges, str(path), ["src", "dst"], buckets=8)
    new = edges.select("src", "dst", F.lit("k").alias("kind"))
    # A run that stopped halfway: some buckets are new, and a folder with rows in the making is left.
    half = new.where(F.pmod(F.xxhash64("src", "dst"), F.lit(8)) < 4)
    sinks.upsert_buckets(half, str(path), ["src", "dst"])
    half.write.parquet(str(path / "_staged-lost"))
    assert sinks.read_buckets(spark, str(path)).count() == 60
    got = sinks.upsert_buckets(new, str(path), ["src", "dst"])
    assert rows(got.select("src", "dst", "w", "kind")) == rows(edges.withColumn("kind", F.lit("k")))


def test_upsert_buckets_without_rows(spark, tmp_path, rows):
    none = spark.createDataFrame([], "id long, n string")
    assert sinks.upsert_buckets(none, str(tmp_path / "none"), ["id"]).columns == ["id", "n"]
    with pytest.raises(FileNotFoundError):
        sinks.read_buckets(spark, str(tmp_path / "none"))
    key_only = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    assert rows(sinks.upsert_buckets(key_only, str(tmp_path / "keys"), ["id"])) == [(1,), (2,)]


def test_graph_is_stored_and_read(spark, tmp_path, rows):
    from topicloom.model import Graph

    topics = spark.createDataFrame([("a",), ("b",)], "name string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    sinks.save_graph(Graph({"Topic": topics}, {"SUBTOPIC_OF": edges}), str(tmp_path / "g"))
    back = sinks.load_graph(spark, str(tmp_path / "g"), ["Topic"], ["SUBTOPIC_OF"])
    assert rows(back.nodes["Topic"]) == [("a",), ("b",)]
    assert rows(back.edges["SUBTOPIC_OF"]) == [("a", "b")]
