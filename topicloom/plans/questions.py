"""The eight questions over the graph. Every limit is an argument; ``None`` returns all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.constants import DOMAIN_EDGES, HUB_LABELS, HUB_TYPES, TREND_YEARS
from topicloom.functions.columns import pct, round_half_up
from topicloom.graph.hubs import hubs
from topicloom.graph.similarity import node_similarity, similar_to
from topicloom.model import Graph
from topicloom.operators.aggregates import count_by, growth, sum_if
from topicloom.operators.joins import (
    authors_of_pairs, present_in_all, restrict_to, topic_counts, with_totals,
)
from topicloom.operators.topk import first_n, top_k_array, top_n
from topicloom.runtime import stored


def _domain_edges(graph: Graph) -> dict[str, DataFrame]:
    return {domain: graph.edges[kind] for domain, kind in DOMAIN_EDGES.items()}


def q1_topic_usage(graph: Graph, n: int | None = 10) -> DataFrame:
    """Topics by their mean share over papers, job roles and posts."""
    edges = _domain_edges(graph)
    counts = topic_counts(
        graph.nodes["Topic"], paper_count=edges["Paper"], job_count=edges["JobRole"], so_count=edges["StackOverflowPost"]
    )
    counts = with_totals(
        counts, papers=graph.nodes["Paper"], jobs=graph.nodes["JobRole"], posts=graph.nodes["StackOverflowPost"]
    )
    paper, job, post = pct("paper_count", "papers"), pct("job_count", "jobs"), pct("so_count", "posts")
    shares = counts.select(
        F.col("name").alias("topic"), "paper_count", "job_count", "so_count",
        round_half_up(paper, 2).alias("paper_pct"), round_half_up(job, 2).alias("job_pct"),
        round_half_up(post, 2).alias("so_pct"), round_half_up((paper + job + post) / 3.0, 2).alias("avg_pct"),
    )
    return top_n(shares, [F.desc("avg_pct"), "topic"], n)


def q2_single_domain(graph: Graph, domain: str = "Paper", n: int | None = 10) -> DataFrame:
    """Topics of one domain that the other two lack, by their number of entities there."""
    others = [d for d in DOMAIN_EDGES if d != domain]
    counts = topic_counts(graph.nodes["Topic"], **_domain_edges(graph))
    only = counts.where((F.col(domain) > 0) & (F.col(others[0]) == 0) & (F.col(others[1]) == 0))
    return top_n(only, [F.desc(domain), "name"], n).select(F.col("name").alias("topic"))


def q3_all_domains(graph: Graph, n: int | None = 5) -> DataFrame:
    """Topics present in papers, job roles and posts."""
    found = present_in_all(graph.nodes["Topic"], *_domain_edges(graph).values())
    return first_n(found.select(F.col("name").alias("topic")), "topic", n)


def yearly_counts(graph: Graph, years: Sequence[int] = TREND_YEARS, per_parent: bool = True) -> DataFrame:
    """``topic, year, count`` of the papers on topics that have a parent.

    A topic with two parents counts each paper twice unless ``per_parent`` is off.
    """
    papers = graph.nodes["Paper"].where(F.col("year").isin(*years)).select("eid", "year")
    links = graph.edges["ADDRESSES_TOPIC"].join(papers, F.col("src") == F.col("eid")).select("src", "dst", "year")
    counted = count_by(links, "dst", "year")
    parents = graph.edges["SUBTOPIC_OF"].groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("parents"))
    times = F.col("parents") if per_parent else F.lit(1)
    return counted.join(parents, "dst").select(
        F.col("dst").alias("topic"), F.col("year").cast("int").alias("year"), (F.col("count") * times).alias("count")
    )


def q4_trends(
    graph: Graph, years: Sequence[int] = TREND_YEARS, n: int | None = 10, per_parent: bool = True
) -> DataFrame:
    """Yearly series of each topic and its growth between the first and the last year."""
    counts = yearly_counts(graph, years, per_parent)
    at = lambda year: sum_if(F.col("year") == year, "count")
    trends = counts.groupBy("topic").agg(
        F.sum("count").alias("total"),
        F.sort_array(F.collect_list(F.struct("year", "count"))).alias("yearly_counts"),
        at(min(years)).alias("count_start"),
        at(max(years)).alias("count_end"),
    )
    return top_n(
        trends.withColumn("growth", F.col("count_end") - F.col("count_start")), [F.desc("growth"), "topic"], n
    )


def q5_growth_match(graph: Graph, years: Sequence[int] = TREND_YEARS, n: int = 10) -> DataFrame:
    """The ``n`` fastest growing topics that job roles and posts have too, with both counts."""
    grown = growth(yearly_counts(graph, years), "topic", "year", "count", min(years), max(years))
    top = top_n(grown, [F.desc("growth"), "topic"], n).select("topic")
    topics = restrict_to(graph.nodes["Topic"], top).select("name")

    def distinct_ends(kind: str) -> DataFrame:
        edges = graph.edges[kind]
        return edges.join(topics, edges["dst"] == topics["name"], "left_semi").select("src", "dst").distinct()

    counts = topic_counts(
        topics, job_count=distinct_ends("REQUIRES_KNOWLEDGE_OF"), so_count=distinct_ends("IS_TAGGED_WITH")
    )
    both = counts.where((F.col("job_count") > 0) & (F.col("so_count") > 0))
    return both.select(F.col("name").alias("topic"), "job_count", "so_count").orderBy(F.desc("job_count"), "topic")


BATCHES = (256, 4096)  # papers tried before all papers are compared


def similar_papers(
    graph: Graph, cutoff: float, k: int, shown: Callable[[DataFrame], DataFrame] = lambda near: near, n: int | None = None
) -> DataFrame:
    """``paper, neighbour, sim, rank``: the ``k`` nearest papers by shared topics, filtered by ``shown``.

    With ``n`` papers are tried in order of their ids, in growing batches, until ``n`` of them have a row left; the
    result then holds the rows of the papers tried. If the batches find too few, all papers are compared.
    """
    edges = graph.edges["ADDRESSES_TOPIC"]

    def named(near: DataFrame) -> DataFrame:
        return shown(near.select(F.col("node").alias("paper"), "neighbour", round_half_up("similarity", 3).alias("sim"), "rank"))

    found, last = None, None
    for size in BATCHES if n is not None else ():
        left = edges.select(F.col("src").alias("node")).where(F.col("src").isNotNull() if last is None else F.col("src") > last)
        batch = stored(first_n(left.distinct(), "node", size))
        tried, last = batch.agg(F.count("*"), F.max("node")).first()
        if tried:
            rows = named(similar_to(edges, batch, top_k=k, cutoff=cutoff))
            found = rows if found is None else found.unionByName(rows)
        if tried < size or found.select("paper").distinct().count() >= n:
            break
    else:
        return named(node_similarity(edges, top_k=k, cutoff=cutoff))
    return named(node_similarity(edges, top_k=k, cutoff=cutoff)) if found is None else found


def q6_similar_papers(graph: Graph, cutoff: float = 0.3, k: int = 3, n: int | None = 3) -> DataFrame:
    """Papers with their most similar papers as an array of ``{title, sim}``."""
    papers = graph.nodes["Paper"].select("eid", "title")

    def known(near: DataFrame) -> DataFrame:
        near = near.join(papers.select(F.col("eid").alias("neighbour")), "neighbour", "left_semi")
        return near.join(papers.select(F.col("eid").alias("paper")), "paper", "left_semi")

    near = similar_papers(graph, cutoff, k, known, n)
    if n is not None:
        # The papers are chosen before titles are fetched and arrays are made.
        chosen = first_n(near.select("paper").distinct(), "paper", n)
        near = near.join(F.broadcast(chosen), "paper", "left_semi")
    titled = near.join(papers.select(F.col("eid").alias("neighbour"), F.col("title")), "neighbour")
    top = top_k_array(titled, "paper", "rank", k, ["title", "sim"], name="top_similar")
    named = top.join(papers, F.col("paper") == F.col("eid")).select(
        F.col("eid").alias("paper_eid"), F.col("title").alias("paper_title"), "top_similar"
    )
    return first_n(named, "paper_eid", n)


def q7_similar_authors(graph: Graph, cutoff: float = 0.8, k: int = 3, n: int | None = 3) -> DataFrame:
    """Author lists of paper pairs that are nearly alike.

    An author list is as long as one paper has authors, so it fits a row.
    """
    authored = graph.edges["AUTHORED"].select("src", "dst").distinct()
    titles = graph.nodes["Paper"].select("eid", "title")
    # Papers that can be shown; without this the limit would count pairs that have no row.
    with_author = authored.select(F.col("dst").alias("p")).distinct().join(titles, F.col("p") == F.col("eid"), "left_semi")

    def with_authors(near: DataFrame) -> DataFrame:
        near = near.join(with_author, F.col("paper") == F.col("p"), "left_semi")
        return near.join(with_author, F.col("neighbour") == F.col("p"), "left_semi")

    pairs = similar_papers(graph, cutoff, k, with_authors, n)
    pairs = first_n(pairs, ["paper", "rank"], n) if n is not None else pairs
    sides = authors_of_pairs(pairs, authored)

    def names(side: int):
        return F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("author"))))

    lists = sides.groupBy("paper", "neighbour", "sim", "rank").agg(
        names(1).alias("paper_authors"), names(2).alias("similar_paper_authors")
    )
    named = (
        lists.join(titles.select(F.col("eid").alias("paper"), F.col("title").alias("paper_title")), "paper")
        .join(titles.select(F.col("eid").alias("neighbour"), F.col("title").alias("similar_paper_title")), "neighbour")
        .select("paper", "neighbour", "paper_title", "similar_paper_title", "paper_authors", "similar_paper_authors",
                F.col("sim").alias("sim_score"), "rank")
    )
    return first_n(named, ["paper", "rank"], n).drop("rank")


def q8_hubs(
    graph: Graph, labels: Sequence[str] = HUB_LABELS, types: Sequence[str] = HUB_TYPES, k: int | None = 10,
    by: str = "degree", sources: int | None = None, measures: Sequence[str] = ("degree", "pagerank"),
) -> DataFrame:
    """Hub candidates per label on the full graph."""
    return hubs(graph, labels, types, k=k, by=by, sources=sources, measures=measures)
