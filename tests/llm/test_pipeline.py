"""The pipeline on planted cases, and each stage on what the one before kept."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from topicloom.llm.common import written
from topicloom.llm.queries import QUERIES

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(9)

    def words(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]

    def text(n, per_line=12):
        w = words(n)
        return "\n".join(" ".join(w[i:i + per_line]) for i in range(0, n, per_line))

    docs, labels = [], []
    for i in range(120):
        body = text(rng.randint(60, 200)).split(" ")
        if i % 6 == 0:
            for _ in range(6):
                body[rng.randrange(len(body))] = rng.choice(["scumbag", "idiotic", "worthless"])
        docs.append([i, " ".join(body)])
        labels.append((i, 1, int(i % 6 == 0)))
    base = words(200)
    docs.append([200, " ".join(base)])
    docs.append([201, " ".join(base[:100] + ["changed"] + base[101:])])  # a near copy
    passage = words(70)
    docs.append([210, " ".join(words(80) + passage)])
    docs.append([211, " ".join(words(60) + passage + words(60))])
    block = text(96).split("\n")
    docs.append([220, "\n".join(text(36).split("\n") + block)])
    docs.append([221, "\n".join(text(48).split("\n") + block)])
    docs += [[230, ""], [231, None], [232, "short text"]]
    path = tmp_path_factory.mktemp("planted")
    rows = [(i, t, None, "s", None) for i, t in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), {i: t for i, t in docs}


def test_stages_catch_what_is_planted(spark, planted):
    sf_dir, texts = planted
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(corpus_pipeline.STAGES) - 1:
            docs = written(docs, "stage")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            kept.append({r.doc_id: r.text for r in docs.collect()})
    clean = {i for i in texts if i >= 200 or i % 6}
    assert set(kept[0]) == clean and all(kept[0][i] == texts[i] for i in clean)
    assert set(kept[1]) == clean
    changed = {i for i in clean if kept[1][i] != texts[i]}
    assert changed == {221} and len(kept[1][221]) < len(texts[221])
    assert set(kept[2]) == clean - {201}
    assert {i for i in kept[2] if kept[3][i] != kept[2][i]} <= {211, 221} and 211 in {i for i in kept[2] if kept[3][i] != kept[2][i]}
    assert not any(" ".join(texts[210].split()[j:j + 13]) in kept[3][211] for j in range(80, 138))
    by_doc = defaultdict(int)
    for r in docs.collect():
        by_doc[r.doc_id] += r.length
        assert r.length == len(r.ids) // 4
    assert set(by_doc) == set(kept[3])
    assert all(r.doc_tokens == by_doc[r.doc_id] for r in docs.collect())


def test_run_is_the_stages_and_ends_in_pieces(spark, planted):
    pieces = corpus_pipeline.run(spark, planted[0])
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert 201 not in {r.doc_id for r in pieces.select("doc_id").distinct().collect()}


def test_rows_that_repeat_an_id_keep_their_own_text(spark):
    """Each row is cut by itself: an id joins no row to the text of another."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage, "a"), (2, f"x1 {passage} x2", "b"), (2, "y1\ny2", "c"), (2, f"z1 {passage} z2", "d"), (3, None, "e"), (None, passage, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.cut_repeated_passages(spark, df, "").collect()
    assert sorted((r.lang, r.doc_id, r.text) for r in got) == [
        ("a", 1, passage), ("b", 2, "x1 x2"), ("c", 2, "y1\ny2"), ("d", 2, "z1 z2"), ("e", 3, None), ("f", None, passage)]


def test_every_operator_has_a_query_and_names_are_in_order():
    assert [int(n[2:].split("_")[0]) for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "substring dedup", "packing"]
