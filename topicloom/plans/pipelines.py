"""Entity pipelines: from raw frames to the pieces of the graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.constants import (
    ANSWER_POST_TYPE, EMBEDDING_DIM, IT_WORDS, LINKS_PER_ENTITY, POST_THRESHOLD, POST_YEARS, ROOT_TOPIC,
    SCOPE_DEPTH, STOP_KEYWORDS, TOPICS_PER_PAPER,
)
from topicloom.functions.columns import (
    normalize_column_names, snake_case_columns, split_clean, tags_to_csv, to_long,
)
from topicloom.functions.predicates import drop_containing, has_word, years_in
from topicloom.functions.text import clean_html, normalize_keyword, normalize_title
from topicloom.graph.ontology import canonical_hierarchy, descendants
from topicloom.model import Graph
from topicloom.operators.classify import classify_topics
from topicloom.operators.encode import embed
from topicloom.operators.joins import companies_with_jobs, denormalize_jobs
from topicloom.operators.linking import link_topics
from topicloom.operators.people import author_affiliations, paper_authors
from topicloom.operators.upsert import hierarchy_to_graph, upsert_edges, upsert_nodes
from topicloom.runtime import cut_lineage

# The properties a paper node keeps.
PAPER_COLUMNS = (
    "eid", "title", "year", "doi", "document_type", "source", "publication_stage", "cited_by", "open_access",
    "author_keywords",
)


def papers_pipeline(raw: DataFrame) -> Graph:
    """Paper, Author and Affiliation nodes with AUTHORED and AFFILIATED_WITH edges."""
    # The raw files are read and cleaned once; nodes and edges are made of the written rows.
    papers = cut_lineage(normalize_column_names(raw))
    nodes = upsert_nodes(None, papers.select(*[c for c in PAPER_COLUMNS if c in papers.columns]), "eid")
    written = paper_authors(papers)
    pairs = author_affiliations(papers)
    authors = written.select("author").unionByName(pairs.select("author")).distinct()
    affiliations = pairs.select("affiliation").distinct()
    return Graph(
        {"Paper": nodes, "Author": authors, "Affiliation": affiliations},
        {
            "AUTHORED": upsert_edges(
                None, written.select(F.col("author").alias("src"), F.col("eid").alias("dst")),
                authors, papers.select("eid"),
            ),
            "AFFILIATED_WITH": pairs.select(F.col("author").alias("src"), F.col("affiliation").alias("dst")),
        },
    )


def jobs_pipeline(
    companies: DataFrame, industries: DataFrame, job_industries: DataFrame, postings: DataFrame,
    words: Sequence[str] = IT_WORDS,
) -> Graph:
    """Job, JobRole and Company nodes of the chosen industries with HAS_ROLE and POST edges."""
    jobs = (
        denormalize_jobs(postings, job_industries, industries)
        .drop("salary_id", "industry_id")
        .where(has_word("industry_name", words))
        .withColumn("company_id", to_long("company_id"))
    )
    jobs = cut_lineage(jobs)  # read by five of the six outputs
    roles = jobs.dropna(subset=["title"]).select("job_id", normalize_title("title").alias("name")).distinct()
    known = cut_lineage(companies.withColumn("company_id", to_long("company_id")))
    return Graph(
        {
            "Job": upsert_nodes(None, jobs, "job_id"),
            "JobRole": roles.select("name").distinct(),
            "Company": upsert_nodes(None, companies_with_jobs(known, jobs), "company_id"),
        },
        {
            "HAS_ROLE": roles.select(F.col("job_id").alias("src"), F.col("name").alias("dst")),
            "POST": upsert_edges(
                None, jobs.select(F.col("company_id").alias("src"), F.col("job_id").alias("dst")),
                known.select("company_id"), jobs.select("job_id"),
            ),
        },
    )


def posts_silver(raw: DataFrame, years: Sequence[int] = POST_YEARS) -> DataFrame:
    """Questions of the chosen years with clean body and comma-separated tags, snake_case names."""
    kept = raw.where(years_in("_CreationDate", years)).where(F.col("_PostTypeId") != ANSWER_POST_TYPE)
    cleaned = (
        kept.withColumn("body", clean_html("_Body")).drop("_Body")
        .withColumn("tags", tags_to_csv("_Tags")).drop("_Tags")
    )
    return snake_case_columns(cleaned)


def posts_pipeline(raw: DataFrame, years: Sequence[int] = POST_YEARS) -> Graph:
    return Graph({"StackOverflowPost": upsert_nodes(None, posts_silver(raw, years), "id")}, {})


def ontology_pipeline(triples: DataFrame) -> Graph:
    """Topic nodes and SUBTOPIC_OF edges out of raw ontology triples."""
    topics, subtopic_of = hierarchy_to_graph(canonical_hierarchy(triples))
    return Graph({"Topic": topics}, {"SUBTOPIC_OF": subtopic_of})


def classified_to_edges(classified: DataFrame, papers: DataFrame, topics: DataFrame) -> DataFrame:
    """ADDRESSES_TOPIC edges of a classified layer ``eid, result_cso``.

    Labels are trimmed and compared with topic names in normal form, so ``Machine Learning``
    meets ``machine_learning``.
    """
    named = topics.select(F.col("name"), normalize_keyword("name").alias("word"))
    labels = classified.select(
        F.col("eid").alias("src"), F.explode(split_clean("result_cso", ",")).alias("label")
    ).select("src", normalize_keyword("label").alias("word"))
    edges = labels.join(named, "word").select("src", F.col("name").alias("dst"))
    return upsert_edges(None, edges, papers, topics.select("name"))


def paper_topics_pipeline(
    papers: DataFrame, vocab: DataFrame, subtopic_of: DataFrame, topics: DataFrame, k: int = TOPICS_PER_PAPER
) -> DataFrame:
    """Classify every paper and tie it to its topics."""
    found = classify_topics(papers, vocab, subtopic_of, k=k)
    return upsert_edges(
        None, found.select(F.col("eid").alias("src"), F.col("topic").alias("dst")),
        papers.select("eid"), topics.select("name"),
    )


def topic_vectors_pipeline(
    edges: DataFrame, root: str = ROOT_TOPIC, stop: Sequence[str] = STOP_KEYWORDS, max_depth: int = SCOPE_DEPTH,
    encoder=None, dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """``topic, embedding`` of the topics near the root, without the too general ones."""
    scope = drop_containing(descendants(edges, root, max_depth), "topic", stop)
    return embed(scope.select("topic"), "topic", encoder, dim)


def role_vectors_pipeline(roles: DataFrame, encoder=None, dim: int = EMBEDDING_DIM) -> DataFrame:
    """``job_title, embedding`` of the job roles ``name``."""
    titles = roles.where(F.col("name").isNotNull()).select(F.col("name").alias("job_title")).distinct()
    return embed(titles, "job_title", encoder, dim)


def post_vectors_pipeline(posts: DataFrame, encoder=None, dim: int = EMBEDDING_DIM) -> DataFrame:
    """``id, embedding`` of posts: the text of a post is its body, a line end and its tags."""
    texts = posts.where(F.col("id").isNotNull()).select("id", F.concat_ws("\n", F.coalesce("body", F.lit("")), F.coalesce("tags", F.lit(""))).alias("text"))
    return embed(texts, "text", encoder, dim).drop("text")


def link_pipeline(
    entities: DataFrame, topics: DataFrame, key: str, entity_nodes: DataFrame, topic_nodes: DataFrame,
    threshold: float = POST_THRESHOLD, k: int = LINKS_PER_ENTITY, dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """Edges entity to topic with ``cosine_similarity``, both ends checked against the nodes."""
    links = link_topics(entities, topics, key=key, threshold=threshold, k=k, dim=dim)
    return upsert_edges(
        None, links.select(F.col(key).alias("src"), F.col("topic").alias("dst"), "cosine_similarity"),
        entity_nodes, topic_nodes, props=["cosine_similarity"],
    )
