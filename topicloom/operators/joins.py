"""Joins of the entity tables and of the graph.

No join carries a broadcast hint: Spark broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, where adaptive execution splits
hot keys. In every join below at most one side repeats its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def denormalize_jobs(jobs: DataFrame, job_industries: DataFrame, industries: DataFrame) -> DataFrame:
    """Postings with their industries; a posting with n industries gives n rows."""
    named = job_industries.join(industries, "industry_id")
    return jobs.join(named, "job_id")


def companies_with_jobs(companies: DataFrame, jobs: DataFrame, key: str = "company_id") -> DataFrame:
    """Companies that posted at least one of the jobs."""
    posting = jobs.select(key).where(F.col(key).isNotNull()).distinct()
    return companies.where(F.col(key).isNotNull()).join(posting, key, "left_semi")


def _pointed_at(edges: DataFrame) -> DataFrame:
    """Target ends, each once: hot targets collapse on the map side, before any shuffle."""
    return edges.select("dst").distinct()


def present_in_all(topics: DataFrame, *edges: DataFrame) -> DataFrame:
    """Topics (column ``name``) that every edge set points at."""
    ends = [_pointed_at(e) for e in edges]
    return reduce(lambda kept, e: kept.join(e, kept["name"] == e["dst"], "left_semi"), ends, topics)


def only_in(topics: DataFrame, keep: DataFrame, *absent: DataFrame) -> DataFrame:
    """Topics that ``keep`` points at and none of ``absent`` does."""
    found = present_in_all(topics, keep)
    ends = [_pointed_at(e) for e in absent]
    return reduce(lambda kept, e: kept.join(e, kept["name"] == e["dst"], "left_anti"), ends, found)


def topic_counts(topics: DataFrame, **edges: DataFrame) -> DataFrame:
    """One count column per edge set, 0 where a topic has no edge.

    All edge sets are counted in one aggregation, so there is one shuffle of pre-counted rows.
    """
    zero = F.lit(0).cast("long")

    def marked(df: DataFrame, key: str, name: str | None) -> DataFrame:
        return df.select(
            F.col(key).alias("name"), *[(F.lit(1).cast("long") if n == name else zero).alias(n) for n in edges],
            F.lit(name is None).alias("is_topic"),
        )

    rows = reduce(DataFrame.unionByName, [marked(topics, "name", None), *[marked(e, "dst", n) for n, e in edges.items()]])
    return (
        rows.groupBy("name")
        .agg(*[F.sum(n).alias(n) for n in edges], F.bool_or("is_topic").alias("is_topic"))
        .where("is_topic")
        .drop("is_topic")
    )


def papers_with_subtopic(addresses: DataFrame, subtopic_of: DataFrame, per_parent: bool = True) -> DataFrame:
    """Edges to topics that have a parent: once per parent, or once when ``per_parent`` is off."""
    if not per_parent:
        children = subtopic_of.select("src").distinct()
        return addresses.join(children, addresses["dst"] == children["src"], "left_semi")
    parents = subtopic_of.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("parents"))
    repeated = addresses.join(parents, "dst")
    return repeated.select("src", "dst", F.explode(F.sequence(F.lit(1), F.col("parents").cast("int"))).alias("nth"))


def authors_of_pairs(pairs: DataFrame, authored: DataFrame, a: str = "paper", b: str = "neighbour") -> DataFrame:
    """Each pair with every author of its first and of its second paper, as rows ``side, author``.

    Pairs in which one paper has no author vanish.
    """
    papers_with_author = authored.select(F.col("dst").alias("with_author")).distinct()
    kept = (
        pairs.join(papers_with_author, F.col(a) == F.col("with_author"), "left_semi")
        .join(papers_with_author, F.col(b) == F.col("with_author"), "left_semi")
    )
    sides = kept.select(
        "*", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col(a).alias("dst")),
                               F.struct(F.lit(2).alias("side"), F.col(b).alias("dst")))).alias("end")
    ).select("*", "end.side", "end.dst").drop("end")
    return sides.join(authored.select(F.col("src").alias("author"), "dst"), "dst").drop("dst")


def with_totals(df: DataFrame, **totals: DataFrame) -> DataFrame:
    """Add the row count of each frame to every row, as a scalar subquery."""
    return df.select("*", *[t.agg(F.count("*")).scalar().alias(name) for name, t in totals.items()])


def restrict_to(topics: DataFrame, top: DataFrame, key: str = "name") -> DataFrame:
    """The topics named in a short list."""
    return topics.join(top.select(F.col("topic").alias(key)).distinct(), key)


def canonicalize(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """Replace ``col`` by ``mapping(name -> canonical)`` where there is an entry."""
    renamed = mapping.select(F.col("name").alias(col), F.col("canonical").alias("_canonical"))
    return (
        df.join(renamed, col, "left")
        .withColumn(col, F.coalesce("_canonical", col))
        .drop("_canonical")
        .select(*df.columns)
    )
