"""The test tables seen as a graph (the mapping is described in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.model import Graph

# Years of the trend questions on the test tables.
PROXY_YEARS = (1995, 1999, 2000, 2001)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long texts; how it is split is up to the session's split size."""
    return table(spark, sf_dir, name)


def part_topic(key: str) -> Column:
    return F.concat(F.lit("part_"), F.col(key).cast("string"))


def proxy_hierarchy(part: DataFrame) -> DataFrame:
    """``parent, child``: parts below their brand and, when small, below their type; all below ``catalog``."""
    kind = F.concat(F.lit("type_"), F.col("p_type"))
    pair = lambda parent, child: F.struct(parent.alias("parent"), child.alias("child"))
    brand, name, top = F.col("p_brand"), part_topic("p_partkey"), F.lit("catalog")
    pairs = F.array(pair(brand, name), pair(top, brand), pair(top, kind))
    pairs = F.when(F.col("p_size") <= 25, F.array_append(pairs, pair(kind, name))).otherwise(pairs)
    return part.select(F.explode(pairs).alias("e")).select("e.parent", "e.child").distinct()


def proxy_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    part, lineitem, orders, events = t("part"), t("lineitem"), t("orders"), t("events")
    customer, supplier, nation = t("customer"), t("supplier"), t("nation")

    names = F.array(
        part_topic("p_partkey"), F.col("p_brand"), F.concat(F.lit("type_"), F.col("p_type")), F.lit("catalog")
    )
    nodes = {
        "Topic": part.select(F.explode(names).alias("name")).distinct(),
        "Paper": orders.select(
            F.col("o_orderkey").alias("eid"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("title"),
            F.year("o_orderdate").alias("year"),
        ),
        "JobRole": supplier.select(F.col("s_suppkey").alias("name")),
        "StackOverflowPost": events.where(F.col("event_type") != "error").select(F.col("event_id").alias("id")),
        "Author": customer.select(F.col("c_name").alias("author")).union(supplier.select("s_name")).distinct(),
        "Company": nation.select(F.col("n_name").alias("company_id")),
        "Job": customer.select(F.col("c_custkey").alias("job_id")),
    }

    n_parts = part.agg(F.count("*")).scalar()
    n_suppliers = supplier.agg(F.count("*")).scalar()
    k = F.get_json_object("props", "$.k").cast("long")
    wanted = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.09) & (F.col("l_quantity") >= 45)
    lines_by = lineitem.select("l_orderkey", "l_suppkey").distinct().join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    edges = {
        "SUBTOPIC_OF": proxy_hierarchy(part).select(F.col("child").alias("src"), F.col("parent").alias("dst")),
        "ADDRESSES_TOPIC": lineitem.select("l_orderkey", "l_partkey").distinct().select(
            F.col("l_orderkey").alias("src"), part_topic("l_partkey").alias("dst")),
        "REQUIRES_KNOWLEDGE_OF": lineitem.where(wanted).select("l_suppkey", "l_partkey").distinct().select(
            F.col("l_suppkey").alias("src"), part_topic("l_partkey").alias("dst")),
        "IS_TAGGED_WITH": events.where(F.col("event_type") == "view").select(
            F.col("event_id").alias("src"),
            F.concat(F.lit("part_"), ((F.col("user_id") * 13 + k) % n_parts).cast("string")).alias("dst"),
        ),
        "AUTHORED": orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("c_name").alias("src"), F.col("o_orderkey").alias("dst")
        ).union(lines_by.select("s_name", "l_orderkey")).distinct(),
        "POST": customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("n_name").alias("src"), F.col("c_custkey").alias("dst")),
        "HAS_ROLE": customer.select(
            F.col("c_custkey").alias("src"), (F.col("c_custkey") % n_suppliers).alias("dst")),
    }
    return Graph(nodes, edges)
