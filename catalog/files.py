"""Readers and writers: tables are written by our sinks and read back by our sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from catalog.graphs import proxy_triples
from catalog.registry import on_graph, query, rounded
from catalog.texts import CLASSIFIED, TERM_TREE, WORDS, classified, embedded_sql
from topicloom import sinks, sources
from topicloom.functions.columns import round_half_up, topic_slug
from topicloom.operators.encode import embed
from topicloom.operators.topk import limit_per_file
from topicloom.operators.upsert import upsert_nodes
from topicloom.plans.proxy import proxy_hierarchy, table, text_table
from topicloom.runtime import scratch_path
from topicloom.schemas import CLASSIFIED_PAPERS, HIERARCHY, POSTS_XML


@query("s1_csv", "SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal FROM customer")
def s1_csv(spark, sf_dir):
    path = scratch_path(spark, "s1")
    sinks.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return sources.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("s2_csv_tree", "SELECT doc_id, text, lang FROM documents")
def s2_csv_tree(spark, sf_dir):
    path = scratch_path(spark, "s2")
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())])
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs.withColumns({"folder": F.length("lang"), "language": F.col("lang")}).write.partitionBy("folder", "language").option(
        "header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return sources.read_csv_tree(spark, path, schema=schema)


@query("s2_csv_in_splits", "SELECT doc_id, text, lang FROM documents")
def s2_csv_in_splits(spark, sf_dir):
    """Texts with line ends and quotes, written as CSV and read back in splits."""
    path = scratch_path(spark, "s2s")
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())])
    sinks.write_csv(text_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return sources.read_csv_in_splits(spark, path, schema)


@query("s3_xml", """
SELECT event_id AS "_Id", user_id AS "_PostTypeId", event_type AS "_Title", props AS "_Body", '<' || event_type || '><b>' AS "_Tags" FROM events""")
def s3_xml(spark, sf_dir):
    path = scratch_path(spark, "s3")
    posts = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_Id"), F.col("user_id").alias("_PostTypeId"), F.col("event_type").alias("_Title"),
        F.col("props").alias("_Body"), F.concat(F.lit("<"), "event_type", F.lit("><b>")).alias("_Tags"))
    posts.write.format("xml").option("rootTag", "posts").option("rowTag", "row").save(path)
    back = sources.read_xml_rows(spark, path, "row", POSTS_XML)
    return back.select("_Id", F.col("_PostTypeId").cast("long").alias("_PostTypeId"), "_Title", "_Body", "_Tags")


@query("s4_embeddings", "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings")
def s4_embeddings(spark, sf_dir):
    path = scratch_path(spark, "s4")
    sinks.write_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    return sources.read_embeddings(spark, path).select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@query("s5_declared_tree", "SELECT doc_id::VARCHAR AS eid, lang || ', ' || source AS result_cso FROM documents")
def s5_declared_tree(spark, sf_dir):
    path = scratch_path(spark, "s5")
    rows = text_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("eid"), F.concat_ws(", ", "lang", "source").alias("result_cso"))
    sinks.write_csv(rows, f"{path}/one/two")
    return sources.read_csv_tree(spark, path, schema=CLASSIFIED_PAPERS, multiline=False)


@query("s6_bad_rows", "SELECT p_partkey::VARCHAR AS id, p_name AS job_title FROM part WHERE p_size <> 50")
def s6_bad_rows(spark, sf_dir):
    path = scratch_path(spark, "s6")
    extra = F.when(F.col("p_size") == 50, F.concat(F.lit(";"), "p_brand")).otherwise("")
    table(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(";"), "p_name", extra).alias("value")).write.text(path)
    return sources.read_csv(spark, path, sep=";", names=["id", "job_title"], bad_rows="drop")


@query("s6_kept_bad_rows", "SELECT p_partkey || ';' || p_name || ';' || p_brand AS _bad_row FROM part WHERE p_size = 50")
def s6_kept_bad_rows(spark, sf_dir):
    path = scratch_path(spark, "s6k")
    extra = F.when(F.col("p_size") == 50, F.concat(F.lit(";"), "p_brand")).otherwise("")
    table(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(";"), "p_name", extra).alias("value")).write.text(path)
    _, bad = sources.split_bad_rows(sources.read_csv(spark, path, sep=";", names=["id", "job_title"], bad_rows="keep"))
    return bad


@query("s7_triples", on_graph("""
SELECT parent AS subj, child AS obj FROM hierarchy
UNION ALL SELECT 'part_' || p_partkey, 'part_' || (p_partkey - 1) FROM part WHERE p_size = 50
UNION ALL SELECT 'part_' || p_partkey, 'part_' || (p_partkey + 1) FROM part WHERE p_size = 49"""))
def s7_triples(spark, sf_dir):
    path = scratch_path(spark, "s7")
    good = proxy_triples(spark, sf_dir).select(F.concat_ws(",", "subj", "pred", "obj").alias("value"))
    odd = table(spark, sf_dir, "part").select(F.explode(F.array(
        F.concat_ws(",", "p_name", "p_brand"), F.concat_ws(",", "p_name", "p_brand", "p_type", "p_name"))).alias("value"))
    good.union(odd).write.text(path)
    return sources.read_triples(spark, path).select(topic_slug("subj").alias("subj"), topic_slug("obj").alias("obj"))


@query("s8_hierarchy", on_graph("SELECT parent, child FROM hierarchy"))
def s8_hierarchy(spark, sf_dir):
    path = scratch_path(spark, "s8")
    sinks.write_hierarchy(proxy_hierarchy(table(spark, sf_dir, "part")), path)
    return sources.read_hierarchy(spark, path)


@query("s9_source_files", "SELECT lang AS folder, doc_id::VARCHAR AS doc_id, source FROM documents")
def s9_source_files(spark, sf_dir):
    path = scratch_path(spark, "s9")
    docs = text_table(spark, sf_dir, "documents")
    docs.select("doc_id", "source", "lang").write.partitionBy("lang").csv(path)
    back = sources.read_csv_tree(spark, path, names=["doc_id", "source"], multiline=False, with_source=True)
    return back.select(F.regexp_extract("source_file", "lang=([^/]+)/", 1).alias("folder"), "doc_id", "source")


@query("o6_limit_per_file", "SELECT lang AS folder, least(count(*), 100) AS n FROM documents GROUP BY lang")
def o6_limit_per_file(spark, sf_dir):
    path = scratch_path(spark, "o6")
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    docs.repartition("lang").write.partitionBy("lang").csv(path)
    back = sources.read_csv_tree(spark, path, names=["doc_id", "source"], multiline=False, with_source=True)
    return limit_per_file(back, 100).groupBy(F.regexp_extract("source_file", "lang=([^/]+)/", 1).alias("folder")).agg(
        F.count("*").alias("n"))


@query("k1_quoted_csv", """
SELECT '"n_nationkey","n_name"' AS line UNION ALL SELECT '"' || n_nationkey || '","' || n_name || '"' FROM nation""")
def k1_quoted_csv(spark, sf_dir):
    path = scratch_path(spark, "k1")
    sinks.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path, single=True)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("k2_by_year", """
SELECT o_orderkey::VARCHAR AS eid, o_orderstatus AS title, o_orderpriority AS abstract, year(o_orderdate) AS year FROM orders""")
def k2_by_year(spark, sf_dir):
    path = scratch_path(spark, "k2")
    papers = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("eid"), F.col("o_orderstatus").alias("title"),
        F.col("o_orderpriority").alias("abstract"), F.lit("k").alias("author_keywords"), F.year("o_orderdate").alias("year"))
    sinks.write_by_year(papers, path)
    back = spark.read.schema("eid string, title string, abstract string, keywords string, year bigint").csv(path)
    return back.drop("keywords")


@query("k3_embeddings", f"WITH {embedded_sql('doc_id', 'documents', 'text', 32)} SELECT doc_id, i, {rounded('x', 5)} AS x FROM word_vectors")
def k3_embeddings(spark, sf_dir):
    path = scratch_path(spark, "k3")
    sinks.write_embeddings(embed(text_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", dim=32).drop("text"), path)
    places = sources.read_embeddings(spark, path).select("doc_id", F.posexplode("embedding").alias("i", "x"))
    return places.where(F.col("x") != 0).select(
        "doc_id", F.col("i").cast("long").alias("i"), round_half_up(F.col("x").cast("double"), 5).alias("x"))


@query("k4_hierarchy_json", on_graph("SELECT parent, string_agg(child, ',' ORDER BY child) AS children FROM hierarchy GROUP BY parent"))
def k4_hierarchy_json(spark, sf_dir):
    path = scratch_path(spark, "k4")
    sinks.write_hierarchy(proxy_hierarchy(table(spark, sf_dir, "part")), path)
    lines = spark.read.text(path).select(F.explode(F.from_json("value", HIERARCHY)).alias("parent", "children"))
    return lines.select("parent", F.array_join("children", ",").alias("children"))


@query("k5_classified_csv", f"""WITH {WORDS}, {TERM_TREE}, {CLASSIFIED}
SELECT doc_id::VARCHAR AS eid, string_agg(topic, ', ' ORDER BY rank) AS result_cso FROM (
  SELECT doc_id, topic, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS rank FROM scores QUALIFY rank <= 5)
GROUP BY doc_id""")
def k5_classified_csv(spark, sf_dir):
    path = scratch_path(spark, "k5")
    sinks.write_classified(classified(spark, sf_dir).withColumnRenamed("doc_id", "eid"), path)
    return sources.read_csv_tree(spark, path, schema=CLASSIFIED_PAPERS, multiline=False)


@query("k5_classified_all", f"""WITH {WORDS}, {TERM_TREE}, {CLASSIFIED},
ranked AS (
  SELECT doc_id, topic, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS rank FROM scores QUALIFY rank <= 5)
SELECT d.doc_id::VARCHAR AS eid, coalesce(string_agg(topic, ', ' ORDER BY rank), '') AS result_cso
FROM documents d LEFT JOIN ranked ON ranked.doc_id = d.doc_id GROUP BY d.doc_id""")
def k5_classified_all(spark, sf_dir):
    path = scratch_path(spark, "k5all")
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("eid"))
    sinks.write_classified(classified(spark, sf_dir).withColumnRenamed("doc_id", "eid"), path, papers=papers)
    back = sources.read_csv_tree(spark, path, schema=CLASSIFIED_PAPERS, multiline=False)
    return back.withColumn("result_cso", F.coalesce("result_cso", F.lit("")))


@query("k6_upsert_parquet", """
SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier""")
def k6_upsert_parquet(spark, sf_dir):
    path = scratch_path(spark, "k6")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    suppliers.write.parquet(path)
    changed = suppliers.where(F.col("s_acctbal") < 0).select("s_suppkey", F.lit(0.0).alias("s_acctbal"))
    return sinks.upsert_parquet(spark, path, lambda old: upsert_nodes(old, changed, "s_suppkey"))


@query("k6_upsert_buckets", """
SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice < 5000 THEN 0.0 ELSE o_totalprice END AS o_totalprice,
       CASE WHEN o_totalprice < 5000 THEN 'small' END AS note FROM orders
UNION ALL SELECT -1 - s_suppkey, NULL, s_acctbal, 'supplier' FROM supplier""")
def k6_upsert_buckets(spark, sf_dir):
    """Orders stored in buckets; then cheap orders are changed and suppliers added, each by an upsert of its own."""
    path = scratch_path(spark, "k6b")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.upsert_buckets(orders, path, ["o_orderkey"])
    cheap = orders.where(F.col("o_totalprice") < 5000).select(
        "o_orderkey", F.lit(0.0).alias("o_totalprice"), F.lit("small").alias("note"))
    sinks.upsert_buckets(cheap, path, ["o_orderkey"])
    added = table(spark, sf_dir, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("o_orderkey"), F.col("s_acctbal").alias("o_totalprice"), F.lit("supplier").alias("note"))
    return sinks.upsert_buckets(added, path, ["o_orderkey"])


@query("k7_upsert_edge_buckets", """
SELECT l_suppkey AS src, l_partkey AS dst, max(l_quantity) AS weight FROM lineitem
WHERE l_returnflag IN ('A', 'R') GROUP BY l_suppkey, l_partkey""")
def k7_upsert_edge_buckets(spark, sf_dir):
    """Edges of two loads; an edge of both keeps the greater weight, as the second load is ordered and looked up."""
    path = scratch_path(spark, "k7b")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), "l_returnflag")
    first = lines.where(F.col("l_returnflag") == "A").drop("l_returnflag")
    had = sinks.upsert_buckets(first, path, ["src", "dst"])
    second = lines.where(F.col("l_returnflag") == "R").drop("l_returnflag").unionByName(
        had.join(lines.where(F.col("l_returnflag") == "R").select("src", "dst").distinct(), ["src", "dst"], "left_semi"))
    return sinks.upsert_buckets(second, path, ["src", "dst"])
