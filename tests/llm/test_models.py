"""Toxicity, quality and nearest neighbours: held-out accuracy, plain versions and odd rows."""

import random
from itertools import groupby

import numpy as np
from pyspark.sql import functions as F

from topicloom.llm.neighbours import CentroidGraph, distances, nearest_neighbours, split_centroids
from topicloom.llm.quality import fit_discriminant, quality, statistics, with_statistics
from topicloom.llm.queries import QUERIES
from topicloom.llm.toxicity import fit_toxicity, held_out, label_model, linear_classifier, toxicity

SF_DIR = "/root/testdata/sf0.01"


def area(pairs):
    """Area under the curve of ``(score, label)``; ties count half."""
    good, below, total = sum(y for _, y in pairs), 0, 0.0
    for _, group in groupby(sorted(pairs), key=lambda p: p[0]):
        group = list(group)
        ones = sum(y for _, y in group)
        total += ones * (below + (len(group) - ones) / 2)
        below += len(group) - ones
    return total / max(1, good * (len(pairs) - good))


def scored(spark, name, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    return [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]


def test_quality_on_held_out_rows(spark):
    rows = scored(spark, "op5_quality", "quality")
    assert area([r[:2] for r in rows]) > 0.97
    assert np.mean([y == p for _, y, p in rows]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    rows = scored(spark, "op3_toxicity", "toxic")
    assert area([r[:2] for r in rows]) > 0.8
    assert all(y for _, y, p in rows if p)  # clean documents are left alone
    assert np.mean([p for _, y, p in rows if y]) > 0.6


def toxic_rows(seed, count):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["zorgon", "zorgoff", "blight"]) + rng.choice(["", "s", "ing"])
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity_learns_beginnings_of_words(spark):
    train = spark.createDataFrame(toxic_rows(1, 400), "doc_id long, text string, toxic int")
    model = fit_toxicity(train, train.select("doc_id", "toxic"))
    unseen = [(t.replace("zorgon", "zorgxy"), y) for _, t, y in toxic_rows(2, 200)]
    got = spark.createDataFrame(unseen, "text string, y int").select(toxicity(model, F.col("text")).alias("s"), "y").collect()
    assert np.mean([(r.s >= 0.7) == bool(r.y) for r in got]) > 0.97


def test_frequent_neutral_terms_displace_no_mark(spark):
    """Over 20,000 terms stand in more toxic texts than the mark does, and in as many others."""
    common = " ".join(f"{i:05d}neutral" for i in range(12_000))
    rows = [(i, f"{common} no{i}" + (" zorgon" if i < 5 else ""), 1) for i in range(8)]
    rows += [(10 + i, f"{common} own{i}", 0) for i in range(10)] + [(20 + i, f"plain text {i}", 0) for i in range(30)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = fit_toxicity(train, train.select("doc_id", "toxic"))
    assert "zorgon" in model.terms and not any("neutral" in t for t in model.terms)


def test_toxicity_of_odd_rows(spark, odd, none):
    model = fit_toxicity(odd, spark.createDataFrame([(1, 1), (5, 0), (None, 1), (9, None)], "doc_id long, toxic int"))
    got = odd.select(toxicity(model, F.col("text")).alias("s"), held_out("doc_id", 3, 1).alias("h")).collect()
    assert len(got) == odd.count() and all(0 <= r.s <= 1 and r.h is not None for r in got)
    for labels in ([], [(1, 1)], [(1, 0)]):
        model = fit_toxicity(odd, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert len({r.s for r in odd.select(toxicity(model, F.col("text")).alias("s")).collect()}) == 1
    model = fit_toxicity(none, none.select("doc_id", F.lit(1).alias("toxic")))
    assert none.select(toxicity(model, F.col("text")).alias("s")).count() == 0


def test_label_model_weighs_voters_by_what_they_know():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = [np.where(truth, rng.random(4000) < 0.9, rng.random(4000) < 0.05) for _ in range(3)]
    noise = rng.random(4000) < 0.5
    votes = np.array([*good, *[noise] * 6], float).T  # six voters that always agree and know nothing
    posterior = label_model(votes, 0.3, np.where(votes[:, :3].mean(1) > 0.5, 0.8, 0.1))
    assert ((posterior > 0.5) == truth).mean() > 0.95
    weights = linear_classifier(votes, posterior, np.ones(len(votes)))
    assert weights[:3].min() > 5 * abs(weights[3:9]).max()


def test_quality_of_odd_rows(spark, odd, none):
    described = with_statistics(odd.select("doc_id", "text"))
    for labels in ([(1, 1), (6, 0), (5, 0), (2, None), (9, 7)], [(1, 1)], []):
        known = spark.createDataFrame(labels, "doc_id long, label int")
        model = fit_discriminant(described.join(known, "doc_id"))
        got = described.select(quality(model, F.col("statistics")).alias("s")).collect()
        assert len(got) == odd.count() and all(0 <= r.s <= 1 for r in got)
    assert with_statistics(none).count() == 0
    assert all(np.isfinite(statistics(t)).all() for t in (None, "", "\n\n", "x" * 10**6, "!!! ###"))


def test_discriminant_is_the_density_ratio(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, (400, 12)), rng.normal(1, 2, (400, 12))
    rows = [(0, x.tolist()) for x in a] + [(1, x.tolist()) for x in b]
    model = fit_discriminant(spark.createDataFrame(rows, "label int, statistics array<double>"), shrinkage=1e-9)
    share = 13 / 413

    def log_density(x, data):
        spread = np.cov(data.T, bias=True)
        pooled = np.vstack([a, b])
        spread = (1 - share) * spread + share * np.diag(np.diag(np.cov(pooled.T, bias=True)) + 1e-3)
        gap = x - data.mean(0)
        return -0.5 * (gap @ np.linalg.solve(spread, gap)) - 0.5 * np.linalg.slogdet(spread)[1]

    x = rng.normal(0.5, 1, (20, 12))
    want = [1 / (1 + np.exp(log_density(v, a) - log_density(v, b))) for v in x]
    assert np.allclose(model.scores(x), want, atol=1e-8)


def brute(rows, every, k):
    out = {}
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    for i, v in rows:
        if i % every == 0:
            d = np.sqrt(((np.array(v, float) - x) ** 2).sum(1))
            out[i] = [(ids[j], d[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 24))
    rows = [(i, (centers[i % 40] + 0.4 * rng.normal(size=24)).astype("float32").tolist()) for i in range(4000)]
    rows += [(4000 + i, rows[200][1]) for i in range(300)] + [(4300 + i, rng.normal(size=24).astype("float32").tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    want, got = brute(rows, 50, 10), {}
    for r in nearest_neighbours(df, query_every=50).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    hits = 0
    for query, best in want.items():
        mine = sorted(got[query])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & {v for v, _ in best})
    assert hits / (10 * len(want)) >= 0.9
    assert [v for _, v, _ in sorted(got[200])] == list(range(4000, 4010))


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.5]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0]),
            (None, [1.0, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in nearest_neighbours(df, query_every=50, k=2).collect())
    assert got == [(0, 1, 7, 0.0), (0, 2, 50, 0.5), (50, 1, 0, 0.5), (50, 2, 7, 0.5)]
    assert nearest_neighbours(df.where("vec_id < -1"), query_every=50).count() == 0
    assert nearest_neighbours(df.where("vec_id = 0"), query_every=50).count() == 0


def test_centroid_graph_finds_what_a_full_search_finds():
    x = np.random.default_rng(6).normal(size=(3000, 16))
    centroids = split_centroids(x, 20)
    sizes = np.bincount(distances(x, centroids).argmin(1), minlength=len(centroids))
    assert sizes.max() < 8 * sizes.mean()
    ids, _ = CentroidGraph(centroids).nearest(x[:200], 16)
    full = np.argsort(distances(x[:200], centroids), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids[:, :8], full)]) > 0.95


def test_toxicity_without_labelled_documents(spark):
    from topicloom.llm.toxicity import fit_toxicity, toxicity

    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(8, 1), (9, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    for these, known in ((docs.limit(0), labels), (docs, labels), (docs, labels.limit(0)), (docs, spark.createDataFrame([(1, 1)], labels.schema))):
        model = fit_toxicity(these, known)
        scores = [r.s for r in docs.select(toxicity(model, F.col("text")).alias("s")).collect()]
        assert len(scores) == 3 and len(set(scores)) == 1 and 0 <= scores[0] <= 1
