"""Writers for the silver and gold layers and for the stored graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.columns import joined
from topicloom.functions.predicates import maybe_year
from topicloom.model import Graph
from topicloom.operators.aggregates import children_by_parent


def write_csv(df: DataFrame, path: str, single: bool = False, header: bool = True) -> None:
    """Quoted CSV. ``single`` gives one file and with it one writing task: small results only."""
    out = df.coalesce(1) if single else df
    (
        out.write.mode("overwrite")
        .option("header", header)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_by_year(df: DataFrame, path: str, year: int | None = None) -> None:
    """Four text columns of the papers, one folder per year, in a single job."""
    (
        maybe_year(df, "year", year)
        .select("eid", "title", "abstract", "author_keywords", "year")
        .write.mode("overwrite")
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .partitionBy("year")
        .csv(path)
    )


def write_embeddings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_classified(topics: DataFrame, path: str, key: str = "eid", papers: DataFrame | None = None) -> None:
    """One row per paper with its topics as ``a, b, c`` in rank order (a handful per paper).

    ``papers`` holds the keys of all papers that were classified; those without a topic get an empty text.
    """
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("rank", "topic"))), lambda x: x["topic"])
    rows = topics.groupBy(key).agg(joined(ranked).alias("result_cso"))
    if papers is not None:
        rows = papers.select(key).distinct().join(rows, key, "left").withColumn("result_cso", F.coalesce("result_cso", F.lit("")))
    write_csv(rows, path)


def write_hierarchy(edges: DataFrame, path: str) -> None:
    """JSON lines ``{"parent": ["child", ...]}``, one per parent."""
    lines = children_by_parent(edges)
    lines.select(F.to_json(F.create_map("parent", "children")).alias("value")).write.mode("overwrite").text(path)


def save_graph(graph: Graph, path: str) -> None:
    """One Parquet folder per node label and per relationship type."""
    for label, df in graph.nodes.items():
        df.write.mode("overwrite").parquet(f"{path}/nodes/{label}")
    for kind, df in graph.edges.items():
        df.write.mode("overwrite").parquet(f"{path}/edges/{kind}")


def load_graph(spark: SparkSession, path: str, labels: list[str], types: list[str]) -> Graph:
    return Graph(
        {label: spark.read.parquet(f"{path}/nodes/{label}") for label in labels},
        {kind: spark.read.parquet(f"{path}/edges/{kind}") for kind in types},
    )


def upsert_parquet(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replace the Parquet set at ``path`` by ``merge`` of its rows.

    A folder cannot be read and overwritten in one job, so the result is written once, beside
    it, and the folders change names; the old rows are then ``<path>.before``. A run that stops
    between the two renames leaves no ``path``, and the next call goes on from the old rows.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here, staged, before = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + end) for end in ("", ".staged", ".before"))
    files = here.getFileSystem(conf)
    if not files.exists(here) and files.exists(before):
        files.rename(before, here)
    merge(spark.read.parquet(path)).write.mode("overwrite").parquet(staged.toString())
    files.delete(before, True)
    if not files.rename(here, before) or not files.rename(staged, here):
        raise OSError(f"could not put {staged} in the place of {path}")
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)
