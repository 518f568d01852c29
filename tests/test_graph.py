import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topicloom.graph import betweenness as betweenness_module
from topicloom.graph.betweenness import betweenness, betweenness_within
from topicloom.graph import communities, packed_links
from topicloom.graph.communities import leiden, louvain, modularity, settled
from topicloom.graph import pagerank as pagerank_module
from topicloom.graph import projection as projection_module
from topicloom.graph import components as components_module
from topicloom.graph.components import components_by_stars, connected_components, symmetric
from topicloom.graph.hubs import hubs
from topicloom.graph.ontology import canonical_hierarchy, descendants
from topicloom.graph.pagerank import pagerank
from topicloom.graph.projection import project_graph, project_numbers
from topicloom.graph import similarity
from topicloom.graph.similarity import node_similarity, similar_to
from topicloom.model import Graph
from topicloom.plans import questions as q


def brute_similarity(edges, k, cutoff):
    sets = {}
    for a, b in edges:
        sets.setdefault(a, set()).add(b)
    out = set()
    for x in sets:
        near = []
        for y in sets:
            sim = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
            if x != y and sim > cutoff:
                near.append((-sim, y))
        out |= {(x, y, round(-s, 9)) for s, y in sorted(near)[:k]}
    return out


def skewed_edges(seed):
    """A hot topic on a third of the nodes, many copies of one set, a few very wide nodes."""
    rng = random.Random(seed)
    edges = set()
    for node in range(150):
        for _ in range(rng.randint(1, 5)):
            edges.add((node, f"t{int(rng.paretovariate(0.7)) % 40}"))
        if node % 3 == 0:
            edges.add((node, "hot"))
    for node in range(150, 200):
        edges |= {(node, "hot"), (node, "t1")}
    for node in range(200, 204):
        edges |= {(node, f"t{i}") for i in range(node % 7, 40)}
    return edges


@pytest.mark.parametrize("k,cutoff,options", [
    (3, 0.3, {}),
    (10, 0.0, {"hot_degree": 5, "hot_width": 4}),
    (3, 0.3, {"hot_degree": 0, "hot_width": 6}),
    (4, 0.0, {"hot_degree": 20, "hot_width": 2, "set_width": 10}),
    (2, 0.8, {"hot_degree": 10, "hot_width": 3}),
])
def test_node_similarity_routes(spark, k, cutoff, options):
    edges = skewed_edges(k)
    df = spark.createDataFrame([*edges, next(iter(edges))], "src long, dst string")
    got = node_similarity(df, top_k=k, cutoff=cutoff, **options).collect()
    assert {(r.node, r.neighbour, round(r.similarity, 9)) for r in got} == brute_similarity(edges, k, cutoff)


def test_pairs_with_one_common_neighbour_are_not_listed(spark):
    """Of 60 nodes at one topic each gets one short list, and only the pair with two common topics is measured."""
    edges = [(i, "shared") for i in range(60)] + [(i, f"own{i}") for i in range(60)] + [(7, "pair"), (9, "pair")]
    near = node_similarity(spark.createDataFrame(edges, "src long, dst string"), top_k=3)
    assert {(r.node, r.neighbour, round(r.similarity, 9)) for r in near.collect()} == brute_similarity(edges, 3, 0.0)
    plan = near._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "a_via" in line]
    assert joins and all("bits" in line and "arrays_overlap" not in line for line in joins)
    rows = [(i, 2, 2, [i, 99], []) for i in range(60)]
    sets = spark.createDataFrame(rows, "node long, size int, rare int, all array<long>, hot array<long>")
    assert similarity._pair_route(sets, 0.0).isEmpty()
    lists = similarity._first_lists(sets, 0.0, 3).collect()
    assert len(lists) == 60 and all(r.nodes == [0, 1, 2, 3] for r in lists)


@pytest.mark.parametrize("k,cutoff", [(3, 0.3), (10, 0.0), (2, 0.8)])
def test_similar_to_some_nodes(spark, k, cutoff):
    edges = skewed_edges(k)
    df = spark.createDataFrame([*edges, next(iter(edges)), (None, "hot"), (5, None)], "src long, dst string").where("dst IS NOT NULL AND src IS NOT NULL")
    chosen = {0, 1, 150, 151, 200, 203, 999}
    got = similar_to(df, spark.createDataFrame([(i,) for i in chosen], "node long"), top_k=k, cutoff=cutoff).collect()
    want = {row for row in brute_similarity(edges, k, cutoff) if row[0] in chosen}
    assert {(r.node, r.neighbour, round(r.similarity, 9)) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("batches", [(2, 3), (4096,)])
def test_similar_papers_by_batches(spark, monkeypatch, batches):
    """However many papers are tried at a time, the first rows are those of the whole result."""
    monkeypatch.setattr(q, "BATCHES", batches)
    edges = [(i, f"own{i}") for i in range(6)] + [(i, t) for i in range(6, 12) for t in ("a", "b", f"c{i % 3}")]
    graph = Graph(
        {"Paper": spark.createDataFrame([(i, f"t{i}") for i in range(11)], "eid long, title string")},
        {"ADDRESSES_TOPIC": spark.createDataFrame(edges, "src long, dst string"),
         "AUTHORED": spark.createDataFrame([("x", i) for i in range(5, 12)], "src string, dst long")},
    )
    whole = q.q6_similar_papers(graph, cutoff=0.99, n=None).collect()
    for n in (1, 50):
        assert q.q6_similar_papers(graph, cutoff=0.99, n=n).collect() == whole[:n]
    pairs = q.q7_similar_authors(graph, cutoff=0.99, n=None).collect()
    # Paper 11 has no node, so it makes no pair with 8.
    assert len(pairs) == 4 and q.q7_similar_authors(graph, cutoff=0.99, n=3).collect() == pairs[:3]


def brute_pagerank(n, edges, d=0.85, iters=20):
    out = np.zeros(n)
    for a, _ in edges:
        out[a] += 1
    rank = np.full(n, 1 / n)
    for _ in range(iters):
        new = np.full(n, (1 - d) / n + d * rank[out == 0].sum() / n)
        for a, b in edges:
            new[b] += d * rank[a] / out[a]
        rank = new
    return rank


@pytest.mark.parametrize("both_ways", [False, True])
def test_pagerank(spark, both_ways):
    rng = random.Random(3)
    n = 30
    edges = sorted({(rng.randrange(20), rng.randrange(25)) for _ in range(60)})
    edges = [(a, b) for a, b in edges if a != b]
    if both_ways:
        edges = sorted(set(edges) | {(b, a) for a, b in edges})
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    got = {r.id: r["rank"] for r in pagerank(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = brute_pagerank(n, edges)
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(n))


def test_pagerank_of_a_heavy_source(spark, monkeypatch):
    """One source holds a third of all edges; its edges lie under several salts."""
    monkeypatch.setattr(pagerank_module, "EDGES_PER_SALT", 4)
    edges = [(0, i) for i in range(1, 31)] + [(i, (i * 7) % 31) for i in range(1, 31)] + [(i, (i * 3 + 1) % 31) for i in range(1, 31)]
    edges = sorted({(a, b) for a, b in edges if a != b})
    nodes = spark.createDataFrame([(i,) for i in range(31)], "id long")
    got = {r.id: r["rank"] for r in pagerank(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = brute_pagerank(31, edges)
    assert all(abs(got[i] - want[i]) < 1e-12 for i in range(31))


def test_components(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("z", "z")]
    got = dict(connected_components(spark.createDataFrame(chain, "src string, dst string")).collect())
    assert {got[f"n{i:03d}"] for i in range(41)} == {"n000"}
    assert (got["x"], got["y"]) == ("x", "x")


def brute_components(edges):
    label = {}
    for a, b in edges:
        if a != b:
            one, two = label.setdefault(a, {a}), label.setdefault(b, {b})
            if one is not two:
                one |= two
                for x in two:
                    label[x] = one
    return {x: min(members) for x, members in label.items()}


@pytest.mark.parametrize("hot_degree", [0, 100_000])
def test_components_by_stars(spark, hot_degree):
    rng = random.Random(hot_degree)
    cases = [[(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (20, 45)]
    cases += [[], [(1, 1)], [(2, 1), (1, 2), (2, 1), (None, 3), (4, None)]]
    for edges in cases:
        got = components_by_stars(spark.createDataFrame(edges, "src long, dst long"), hot_degree).collect()
        want = brute_components([e for e in edges if None not in e])
        assert len(got) == len(want) and dict(map(tuple, got)) == want, edges
    words = spark.createDataFrame([("b", "a"), ("c", "b"), ("y", "x")], "src string, dst string")
    assert dict(map(tuple, components_by_stars(words).collect())) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_components_of_chains_and_stars_take_few_rounds(spark, monkeypatch):
    """A chain in a scattered order of nodes, one in order, and stars around the least and the greatest node."""
    n, rounds = 60_000, []
    monkeypatch.setattr(components_module, "forget", lambda *tables: rounds.append(1))
    monkeypatch.setattr(components_module, "FEW_HOT", 100)
    nodes = spark.range(n - 1)
    scattered = (F.col("id") * 7919) % n, ((F.col("id") + 1) * 7919) % n
    shapes = [scattered, (F.col("id") + n, F.col("id") + n + 1), (F.lit(2 * n), F.col("id") + 2 * n + 1), (F.lit(4 * n), F.col("id") + 3 * n)]
    parts = [nodes.select(a.cast("long").alias("src"), b.cast("long").alias("dst")) for a, b in shapes]
    edges = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = components_by_stars(edges, hot_degree=1000)
    sizes = {r["component"]: r["count"] for r in got.groupBy("component").count().collect()}
    assert sizes == {i * n: n for i in range(4)}
    assert len(rounds) <= 2 * 16


def cliques(n_cliques, size):
    edges = []
    for c in range(n_cliques):
        members = [f"c{c}_{i}" for i in range(size)]
        edges += itertools.combinations(members, 2)
        edges.append((f"c{c}_0", f"c{(c + 1) % n_cliques}_1"))
    return edges


@pytest.mark.parametrize("method", [louvain, leiden])
def test_communities(spark, method):
    edges = cliques(4, 6)
    got = dict(method(spark.createDataFrame(edges, "src string, dst string")).collect())
    assert set(got) == {x for e in edges for x in e}
    groups = {}
    for node, community in got.items():
        groups.setdefault(community, set()).add(node)
    assert sorted(len(g) for g in groups.values()) == [6, 6, 6, 6]
    for members in groups.values():
        reached, todo = set(), [next(iter(members))]
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += [b if a == x else a for a, b in edges if x in (a, b) and a in members and b in members]
        assert reached == members


def plain_modularity(edges, community):
    m2, inside, total = 2 * len(edges), 0, {}
    for a, b in edges:
        inside += 2 * (community[a] == community[b])
        for x in (a, b):
            total[community[x]] = total.get(community[x], 0) + 1
    return inside / m2 - sum(t * t for t in total.values()) / m2 ** 2


def test_communities_are_settled(spark):
    rng = random.Random(4)
    edges = {(a, b) for a in range(24) for b in range(a) if a // 8 == b // 8 and rng.random() < 0.7 or rng.random() < 0.06}
    df = spark.createDataFrame([(a, b) for a, b in edges] + [(b, a) for a, b in edges] + [(5, 5)], "src long, dst long")
    labels = leiden(df)
    found = dict(labels.collect())
    assert modularity(communities._weighted(df), labels) == pytest.approx(plain_modularity(edges, found)) and plain_modularity(edges, found) > 0.25
    rows = settled(df, labels).collect()
    assert len(rows) == len(found) and all(r.settled and r.named and r.connected for r in rows)
    assert louvain(df.limit(0)).count() == 0


def test_rises_are_exact(spark):
    rng = random.Random(6)
    edges = [(a, b) for a in range(12) for b in range(a) if rng.random() < 0.4]
    links = communities._weighted(spark.createDataFrame(edges, "src long, dst long"))
    before = {x: x % 3 for x in range(12)}
    labels = communities._with_degrees(links, spark.createDataFrame(list(before.items()), "node long, community long"))
    wants = communities.moves_that_gain(links, labels, labels.select("node"), 2.0 * len(edges))
    drawn = communities._drawn(wants, 1)
    rises = communities._rises(links, labels, drawn, 2.0 * len(edges))
    rows = drawn.collect()
    assert rises and set(rises) == {r.draw for r in rows}
    for draw, rise in rises.items():
        after = before | {r.node: r.target for r in rows if r.draw == draw}
        assert rise == pytest.approx(plain_modularity(edges, after) - plain_modularity(edges, before))
    assert rises[3] > 0


def test_refinement_cuts_what_a_split_leaves_whole(spark):
    edges = cliques(6, 5)
    links = communities._weighted(spark.createDataFrame(edges, "src string, dst string"))
    nodes = {x for e in edges for x in e}
    labels = [(x, "c0 and c1" if x < "c2" else x[:2]) for x in nodes]
    rated = communities._with_degrees(links, spark.createDataFrame(labels, "node string, community string"))
    parts = {}
    for r in communities._refined(links, rated, 2.0 * len(edges)).collect():
        parts.setdefault(r.part, set()).add(r.node)
    assert sorted(map(sorted, parts.values())) == [sorted(x for x in nodes if x[:2] == f"c{c}") for c in range(6)]
    assert communities._split_disconnected(links, rated).select("community").distinct().count() == 5


def test_betweenness(spark):
    def run(edges, directed=False, **options):
        df = spark.createDataFrame(edges, "src string, dst string")
        nodes = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e})], "id string")
        links = df if directed else symmetric(df)
        return {r.id: r.betweenness for r in betweenness(nodes, links, directed=directed, **options).collect()}

    assert run([("a", "b"), ("b", "c"), ("c", "d")]) == {"a": 0, "b": 2, "c": 2, "d": 0}
    assert run([("m", x) for x in "abcd"])["m"] == 6
    assert set(run([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]).values()) == {0.5}
    assert run([("a", "b"), ("b", "c"), ("c", "a")], directed=True) == {"a": 1, "b": 1, "c": 1}
    assert run([("a", "b"), ("b", "c")], sources=3) == {"a": 0, "b": 1, "c": 0}


def plain_dependencies(edges, nodes):
    """Brandes' dependencies, one source after the other."""
    after = {v: sorted({b for a, b in edges if a == v and b != v}) for v in nodes}
    out = {v: [] for v in nodes}
    for s in nodes:
        paths, far, order = {s: 1}, {s: 0}, [s]
        for v in order:
            for w in after[v]:
                if w not in far:
                    far[w], paths[w] = far[v] + 1, 0
                    order.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            delta[v] = sum(paths[v] / paths[w] * (1 + delta[w]) for w in after[v] if far[w] == far[v] + 1)
        for v in nodes:
            out[v].append(0.0 if v == s else delta.get(v, 0.0))
    return {v: sum(d) for v, d in out.items()}


@pytest.mark.parametrize("directed", [True, False])
def test_betweenness_of_all_nodes_in_words(spark, directed):
    rng = random.Random(5)
    pairs = {(rng.randrange(90), rng.randrange(90)) for _ in range(170)} | {(0, i) for i in range(40, 90)}
    df = spark.createDataFrame(sorted(pairs), "src int, dst int")
    df = df if directed else symmetric(df)
    nodes = spark.createDataFrame([(i,) for i in [*range(95), 3, None]], "id int")
    want = plain_dependencies({(r.src, r.dst) for r in df.collect()}, range(95))
    got = {r.id: r for r in betweenness_within(nodes, df, error=0.0, directed=directed).collect()}
    assert sorted(got) == list(range(95)) and all(r.bound == 0 for r in got.values())
    assert all(abs(got[v].betweenness - want[v] * (1 if directed else 0.5)) < 1e-9 for v in want)
    assert max(want.values()) > 100


def test_betweenness_stops_within_its_bound(spark, monkeypatch):
    counts, real = [], betweenness_module._words
    monkeypatch.setattr(betweenness_module, "_words", lambda drawn, n: counts.append(n) or real(drawn, n))
    n = 900
    edges = [(i, (i * 7) % 30) for i in range(30, n)] + [(i, (i + 1) % 30) for i in range(30)]
    df = symmetric(spark.createDataFrame(edges, "src int, dst int"))
    nodes = spark.range(n).select(F.col("id").cast("int").alias("id"))
    want = plain_dependencies({(r.src, r.dst) for r in df.collect()}, range(n))
    got = {r.id: r for r in betweenness_within(nodes, df, error=0.4, directed=False).collect()}
    assert 0 < sum(counts) < 0.8 * n
    assert all(abs(got[v].betweenness - want[v] / 2) <= got[v].bound for v in want)
    assert 0 < max(r.bound for r in got.values()) <= 0.4 * (n - 1) * (n - 2) / 2
    again = {r.id: r.betweenness for r in betweenness_within(nodes, df, error=0.4, directed=False).collect()}
    assert all(abs(again[v] - got[v].betweenness) < 1e-6 for v in again)


def test_betweenness_of_nothing(spark):
    none = spark.createDataFrame([], "src int, dst int")
    assert betweenness_within(spark.createDataFrame([], "id int"), none, error=0.1).count() == 0
    two = spark.createDataFrame([(1,), (2,)], "id int")
    assert {(r.id, r.betweenness, r.bound) for r in betweenness_within(two, none, error=0.1).collect()} == {(1, 0.0, 0.0), (2, 0.0, 0.0)}
    one = spark.createDataFrame([(1, 2), (1, 1)], "src int, dst int")
    assert {r.betweenness for r in betweenness_within(two, one, error=0.0).collect()} == {0.0}


def triples(*rows):
    at = lambda x: f"<https://x.example/topics/{x}>"
    return [(at(a), f"<https://x.example/schema#{p}>", at(b)) for a, p, b in rows]


def test_canonical_hierarchy(spark, rows):
    data = triples(
        ("cs", "superTopicOf", "ml"), ("cs", "superTopicOf", "machine_learning"), ("cs", "superTopicOf", "graphs"),
        ("comp_sci", "superTopicOf", "graph"), ("ml", "preferentialEquivalent", "machine_learning"),
        ("comp_sci", "preferentialEquivalent", "cs"), ("graph", "relatedEquivalent", "graphs"),
        ("graphs", "relatedEquivalent", "graphen"), ("machine_learning", "superTopicOf", "ml"),
        ("a1", "relatedEquivalent", "a2"), ("a2", "preferentialEquivalent", "b"), ("cs", "superTopicOf", "a1"),
        ("p1", "preferentialEquivalent", "p2"), ("p2", "preferentialEquivalent", "p3"), ("cs", "superTopicOf", "p1"),
        ("cs", "label", "x"))
    data += [("<https://x.example/other/y>", "<#superTopicOf>", "<https://x.example/topics/ml>")]
    got = canonical_hierarchy(spark.createDataFrame(data, "subj string, pred string, obj string"))
    assert rows(got) == [("cs", "b"), ("cs", "graph"), ("cs", "machine_learning"), ("cs", "p2")]


def test_descendants_by_shortest_distance(spark, rows):
    edges = [("r", "a"), ("a", "b"), ("b", "x"), ("r", "c"), ("c", "x"), ("x", "deep"), ("deep", "r"), ("deep", "too_deep")]
    got = descendants(spark.createDataFrame(edges, "parent string, child string"), "r", 3)
    assert rows(got) == [("a", 1), ("b", 2), ("c", 1), ("deep", 3), ("x", 2)]


@pytest.fixture
def graph(spark):
    frame = spark.createDataFrame
    edges = lambda data, a="long": frame(data, f"src {a}, dst string")
    return Graph(
        {
            "Topic": frame([("ml",), ("db",), ("old",), ("root",), ("unused",)], "name string"),
            "Paper": frame([(i, f"p{i % 5}", 2012 if i < 2 else 2025) for i in range(6)], "eid long, title string, year int"),
            "JobRole": frame([(1,), (2,)], "name long"),
            "StackOverflowPost": frame([(1,), (2,), (3,), (4,)], "id long"),
        },
        {
            "ADDRESSES_TOPIC": edges([(0, "ml"), (2, "ml"), (3, "ml"), (4, "ml"), (1, "db"), (5, "db"), (0, "old"), (1, "old"), (5, "root")]),
            "REQUIRES_KNOWLEDGE_OF": edges([(1, "ml"), (2, "ml")]),
            "IS_TAGGED_WITH": edges([(1, "ml"), (2, "db")]),
            "SUBTOPIC_OF": edges([("ml", "root"), ("ml", "unused"), ("db", "root"), ("old", "root")], "string"),
            "AUTHORED": frame([("ann", 2), ("bob", 3), ("ann", 3)], "src string, dst long"),
        },
    )


def test_questions(graph):
    first = q.q1_topic_usage(graph).first()
    assert (first.topic, first.paper_count, first.job_count, first.so_count) == ("ml", 4, 2, 1)
    assert (first.paper_pct, first.job_pct, first.so_pct, first.avg_pct) == (66.67, 100.0, 25.0, 63.89)
    assert q.q1_topic_usage(graph, n=None).count() == 5
    assert [r.topic for r in q.q2_single_domain(graph).collect()] == ["old", "root"]
    assert [r.topic for r in q.q3_all_domains(graph).collect()] == ["ml"]
    trends = {r.topic: r for r in q.q4_trends(graph).collect()}
    assert (trends["ml"].total, trends["ml"].count_start, trends["ml"].count_end, trends["ml"].growth) == (8, 2, 6, 4)
    assert [tuple(x) for x in trends["old"].yearly_counts] == [(2012, 2)]
    assert "root" not in trends
    once = {r.topic: r.total for r in q.q4_trends(graph, per_parent=False).collect()}
    assert once == {"ml": 4, "db": 2, "old": 2}
    assert [tuple(r) for r in q.q5_growth_match(graph).collect()] == [("ml", 2, 1)]


def test_similar_papers_and_authors(graph):
    got = {r.paper_eid: [(x.title, x.sim) for x in r.top_similar] for r in q.q6_similar_papers(graph, n=None).collect()}
    assert got[2] == [("p3", 1.0), ("p4", 1.0), ("p0", 0.5)]
    rows = q.q7_similar_authors(graph, n=None).collect()
    assert [(r.paper, r.neighbour, list(r.paper_authors), list(r.similar_paper_authors)) for r in rows] == [
        (2, 3, ["ann"], ["ann", "bob"]), (3, 2, ["ann", "bob"], ["ann"])]


def test_hub_measures(graph):
    labels, types = ["Paper", "Topic"], ["ADDRESSES_TOPIC", "SUBTOPIC_OF"]
    nodes, edges = project_graph(graph, labels, types)
    want = {r.id: r.betweenness for r in betweenness(nodes.select("id"), edges.select("src", "dst"), sources=5, directed=False).collect()}
    got = hubs(graph, labels, types, k=None, by="betweenness", sources=5, measures=())
    assert got.columns == ["label", "key", "betweenness"]
    assert {f"{r.label}:{r.key}": r.betweenness for r in got.collect()} == pytest.approx(want)
    assert hubs(graph, labels, types, k=2, by="degree", measures=()).columns == ["label", "key", "degree", "rank"]
    top = hubs(graph, labels, types, k=1, by="pagerank").collect()
    every = hubs(graph, labels, types, k=None).collect()
    for r in top:
        assert r.pagerank == pytest.approx(max(e.pagerank for e in every if e.label == r.label))
    with pytest.raises(ValueError):
        hubs(graph, labels, types, by="betweenness")


@pytest.mark.parametrize("orientation", ["NATURAL", "REVERSE"])
def test_directed_projection(graph, orientation):
    _, edges = project_graph(graph, ["Paper", "Topic"], ["ADDRESSES_TOPIC"], orientation)
    stored = {(f"Paper:{r.src}", f"Topic:{r.dst}") for r in graph.edges["ADDRESSES_TOPIC"].collect()}
    got = {(r.src, r.dst) for r in edges.collect()}
    assert got and got <= (stored if orientation == "NATURAL" else {(b, a) for a, b in stored})


@pytest.mark.parametrize("reached_sinks", [True, False])
def test_pagerank_over_blocks(spark, monkeypatch, reached_sinks):
    """Nodes lie in several blocks, and a round moves a sum per block and end instead of an amount per edge."""
    monkeypatch.setattr(pagerank_module, "numbered_rows", lambda rows: rows.repartition(3, "name").withColumn("id", F.monotonically_increasing_id()).localCheckpoint())
    monkeypatch.setattr(pagerank_module, "EDGES_PER_SALT", 20)
    rng = random.Random(11)
    edges = sorted({(rng.randrange(40), rng.randrange(40 if not reached_sinks else 50)) for _ in range(200)})
    if not reached_sinks:
        edges = sorted({e for a, b in edges for e in ((a, b), (b, a))})
    nodes = spark.createDataFrame([(i,) for i in range(50)], "id long")
    got = {r.id: r["rank"] for r in pagerank(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = brute_pagerank(50, edges)
    assert got == {i: pytest.approx(want[i], abs=1e-12) for i in range(50)}


def test_projection_to_numbers(graph):
    """The same edges as by names; a repeated edge counts once, an edge between topics in either direction."""
    topics = graph.edges["SUBTOPIC_OF"]
    edges = graph.edges | {"SUBTOPIC_OF": topics.unionByName(topics).unionByName(topics.select(F.col("dst").alias("src"), F.col("src").alias("dst")))}
    doubled = Graph(graph.nodes, edges)
    labels, types = ["Paper", "Topic"], ["ADDRESSES_TOPIC", "SUBTOPIC_OF"]
    _, named = project_graph(doubled, labels, types)
    nodes, numbered = project_numbers(doubled, labels, types)
    names = {r.id: r["name"] for r in nodes.collect()}
    assert len(names) == len(set(names.values()))
    assert sorted((names[r.src], names[r.dst]) for r in numbered.collect()) == sorted((r.src, r.dst) for r in named.collect())


@pytest.mark.parametrize("directed", [False, True])
def test_betweenness_of_many_leaves_alike(spark, directed):
    """Leaves below the same parents are one class, apart from drawn ones; the result is that of words, one by one."""
    edges = [(100 + i, p) for i in range(120) for p in ((1, 2) if i % 3 == 0 else (1 + i % 3,))] + [(p, 0) for p in (1, 2, 3)] + [(0, 50), (50, 51)]
    edges = edges if directed else [e for a, b in edges for e in ((a, b), (b, a))]
    df = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e})], "id long")
    assert betweenness_module._classes(df, nodes).select("class").distinct().count() < 10
    got = {r.id: r.betweenness for r in betweenness(nodes, df, directed=directed).collect()}
    want = {r.id: r.betweenness for r in betweenness_within(nodes, df, error=0.0, directed=directed).collect()}
    assert got == pytest.approx(want)
    # From drawn sources: the sum over sources one at a time, each a class of its own.
    drawn = [r.id for r in betweenness_module.pick_sources(nodes, 5).collect()]
    got = {r.id: r.betweenness for r in betweenness(nodes, df, sources=5, directed=directed).collect()}
    each = [{r.id: r.betweenness for r in betweenness(nodes, df, sources=spark.createDataFrame([(x,)], "id long"), directed=directed).collect()} for x in drawn]
    assert got == pytest.approx({x: sum(e[x] for e in each) for x in got})


def test_no_error_takes_one_round(spark, monkeypatch):
    counts, real = [], betweenness_module._words
    monkeypatch.setattr(betweenness_module, "_words", lambda drawn, n: counts.append(n) or real(drawn, n))
    monkeypatch.setattr(betweenness_module, "FIRST_SOURCES", 8)
    edges = [(i, i // 3) for i in range(1, 60)]
    nodes = spark.createDataFrame([(i,) for i in range(60)], "id long")
    assert {r.bound for r in betweenness_within(nodes, spark.createDataFrame(edges, "src long, dst long"), error=0.0).collect()} == {0.0}
    assert counts == [60]


@pytest.mark.parametrize("method", [louvain, leiden])
def test_large_cliques(spark, method):
    """The first step into a clique of more than 100 nodes, along one edge, is a small part of a node's edges."""
    edges = [(c * 1000 + a, c * 1000 + b) for c in range(12) for a in range(130) for b in range(a)] + [(c * 1000, c * 1000 + 1000) for c in range(11)]
    got = {r.node: r.community for r in method(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {c * 1000 + a: c * 1000 for c in range(12) for a in range(130)}


def test_community_rounds_move_numbers(spark, monkeypatch, rows):
    seen, moves = [], communities._local_moves
    monkeypatch.setattr(communities, "_local_moves", lambda links, labels, m2: seen.extend(links.dtypes + labels.dtypes) or moves(links, labels, m2))
    ends = [("z", "y"), ("y", "x"), ("x", "z"), ("c", "b"), ("b", "a"), ("a", "c"), ("z", "a")]
    edges = spark.createDataFrame(ends, "src string, dst string")
    want = [(n, "a") for n in "abc"] + [(n, "x") for n in "xyz"]
    for found in (communities.louvain(edges), communities.leiden(edges)):
        assert found.dtypes == [("node", "string"), ("community", "string")] and rows(found) == want
    assert "string" not in {kind for _, kind in seen}
    assert rows(communities.louvain(edges.limit(0))) == []


def test_similarity_stores_no_counts_without_wide_nodes(spark, monkeypatch, rows):
    written, keep = [], similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name="step": written.append(name) or keep(df, name))
    draw = random.Random(11)
    sets = {n: set(draw.sample(range(40), size)) for n, size in enumerate([1, 2, 3, 7, 8, 9, 10, 11, 12, 9, 8, 2])}
    edges = spark.createDataFrame([(n, f"t{x}") for n, found in sets.items() for x in found], "src long, dst string")
    want = []
    for n, x in sets.items():
        near = sorted((-len(x & y) / len(x | y), m) for m, y in sets.items() if m != n and x & y)[:4]
        want += [(n, m, -s, i + 1) for i, (s, m) in enumerate(near)]
    assert rows(node_similarity(edges, top_k=4)) == sorted(want, key=repr)
    assert "stats" not in written and "sets" in written


@pytest.mark.parametrize("method", [louvain, leiden])
def test_links_of_few_nodes_are_packed(spark, monkeypatch, method):
    """No table of a row per link is stored, and nodes end as settled as by tables."""
    most, keep = [0], communities.stored
    monkeypatch.setattr(communities, "stored", lambda df, name="step": most.append((out := keep(df, name)).count()) or out)
    monkeypatch.setattr(packed_links, "LINKS_PER_CHUNK", 150)
    rng = random.Random(12)
    edges = [(f"n{a}", f"n{b}") for a in range(60) for b in range(60) if rng.random() < (0.5 if a % 4 == b % 4 else 0.04)] + [("n1", None)]
    df = spark.createDataFrame(edges, "src string, dst string")
    found = dict(method(df).collect())
    assert max(most) <= 60 and set(found) == {x for e in edges[:-1] if e[0] != e[1] for x in e}
    once = {(min(e), max(e)) for e in edges[:-1] if e[0] != e[1]}
    assert plain_modularity(once, found) > 0.3 and len(set(found.values())) < 10
    rows = settled(df, spark.createDataFrame(list(found.items()), "node string, community string")).collect()
    assert len(rows) == len(found) and all(r.settled and r.named for r in rows) and (method is louvain or all(r.connected for r in rows))


def test_communities_by_tables(spark, monkeypatch):
    """Graphs of more nodes keep to tables of links."""
    monkeypatch.setattr(communities, "FEW_NODES", 11)
    edges = [(c * 10 + a, c * 10 + b) for c in range(3) for a in range(4) for b in range(a)] + [(0, 10), (10, 20)]
    df = spark.createDataFrame(edges, "src int, dst int")
    assert {r.node: r.community for r in louvain(df).collect()} == {c * 10 + a: c * 10 for c in range(3) for a in range(4)}


def test_packed_steps_agree_with_tables(spark, monkeypatch):
    monkeypatch.setattr(packed_links, "LINKS_PER_CHUNK", 40)
    rng = random.Random(13)
    edges = sorted({(a, b) for a in range(40) for b in range(a) if rng.random() < 0.3})
    df = spark.createDataFrame(edges, "src long, dst long")
    counts = np.bincount(np.ravel(edges), minlength=40)
    links, packed = communities._weighted(df), packed_links.packed_edges(df, pa.array(range(40), pa.int64()), counts)
    assert packed.chunks.count() > 3
    part = np.arange(40) % 13
    for level in range(2):
        degree = packed_links.degrees(packed)
        size, m2 = len(degree), degree.sum()
        label = np.arange(size) % 5
        rated = communities._with_degrees(links, spark.createDataFrame([(i, int(x)) for i, x in enumerate(label)], "node long, community long"))
        assert m2 == 2 * len(edges) and {r.node: r.degree for r in rated.collect()} == {i: x for i, x in enumerate(degree) if x}
        wants = communities.moves_that_gain(links, rated, rated.select("node"), m2)
        total = np.bincount(label, degree, size)
        node, target, gain = packed_links.moves_that_gain(packed, label, degree, total, None, None, m2, communities.LEAST_GAIN)
        assert sorted((r.node, r.target, r.gain) for r in wants.collect()) == list(zip(node, target, gain)) and len(node) > 3
        draws = communities._packed_draws(node, label[node], target, gain, total, 1)
        drawn = communities._drawn(wants, 1).where("draw <> 2")
        assert {(r.node, r.draw) for r in drawn.collect()} == {(v, d) for v, x in zip(node, draws) for d in (0, 1, 3) if x >> d & 1}
        to, bits = label.copy(), np.zeros(size, np.uint8)
        to[node], bits[node] = target, draws
        rises = packed_links.inside_rises(packed, label, to, bits, 4) / m2
        for draw, rise in communities._rises(links, rated, drawn, m2).items():
            shift = sum(np.bincount(c, degree[node] * (draws >> draw & 1) * s, size) for c, s in ((target, 1), (label[node], -1)))
            assert rise == pytest.approx(rises[draw] - (shift * (2 * total + shift)).sum() / m2 ** 2)
        pieces = {}
        for r in communities._refined(links, rated, m2).collect():
            pieces[r.node] = r.part
        parts = communities._packed_parts(packed, np.flatnonzero(degree), label, degree, m2)
        assert {v: parts[v] for v in pieces} == pieces
        packed = packed_links.contracted(packed, part)
        links = communities._contract(links, spark.createDataFrame([(i, int(x)) for i, x in enumerate(part)], "node long, part long"))


def test_drawn_leaves_alike_are_one_row(spark, monkeypatch):
    """Paths start from one of each class of drawn nodes, yet every drawn node counts, but not for itself."""
    drawn, rows_of, real, keep = [], [], betweenness_module._words, betweenness_module.stored

    def words(frame, n):
        drawn.extend(r.id for r in frame.select("id").collect())
        return real(frame, n)

    def counted(df, name="step"):
        out = keep(df, name)
        if name in ("level", "carried"):
            rows_of.append(out.count())
        return out

    monkeypatch.setattr(betweenness_module, "_words", words)
    monkeypatch.setattr(betweenness_module, "stored", counted)
    n = 900
    edges = [(i, i % 6) for i in range(7, n)] + [(i, 6) for i in range(6)]
    df = symmetric(spark.createDataFrame(edges, "src long, dst long"))
    got = {r.id: r for r in betweenness_within(spark.range(n), df, error=0.4, directed=False).collect()}
    assert 100 < len(set(drawn)) == len(drawn) < 0.7 * n and max(rows_of) <= 13
    # In this tree a node lies between a source and all that hangs behind it.
    branch = lambda v: v % 6 if v != 6 else None
    size = {h: sum(branch(v) == h for v in range(n)) for h in range(6)}
    want = {v: 0.0 for v in range(n)} | {6: sum(n - 1 - size[branch(s)] for s in drawn if s != 6)}
    for h in range(6):
        want[h] = sum(n - 2 if branch(s) == h else size[h] - 1 for s in drawn if s != h)
    assert all(got[v].betweenness == pytest.approx(want[v] * n / len(drawn) / 2) for v in range(n))


def test_hub_tables_are_small_on_disk(graph, monkeypatch):
    """An edge is stored once, a name not at all, and chunks and old ranks are no larger than they have to be."""
    kept, dropped, keep, drop = {}, [], pagerank_module.stored, pagerank_module.forget
    for module in (pagerank_module, projection_module):
        monkeypatch.setattr(module, "stored", lambda df, name="step": kept.setdefault(name, []).append(out := keep(df, name)) or out)
    monkeypatch.setattr(pagerank_module, "forget", lambda *t: dropped.extend(t) or drop(*t))
    labels, types = ["Paper", "Topic"], ["ADDRESSES_TOPIC", "SUBTOPIC_OF"]
    _, edges = project_numbers(graph, labels, types)
    assert kept["edges"][0].count() * 2 == edges.count() and kept["numbered"][0].columns == ["label", "key", "id"]
    hubs(graph, labels, types, k=1, by="pagerank", measures=()).collect()
    assert len(kept["ranks"]) > 5 and len(dropped) > 5
