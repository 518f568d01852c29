"""Joins, aggregates, ranking, sorting and upserts on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import on_graph, query
from topicloom.operators import aggregates as a
from topicloom.operators import joins as j
from topicloom.operators import topk as k
from topicloom.operators.upsert import hierarchy_to_graph, upsert_edges, upsert_nodes
from topicloom.plans.proxy import proxy_graph, proxy_hierarchy, table

# --- joins ----------------------------------------------------------------------------------

JOB_INDUSTRIES = "SELECT DISTINCT o_custkey AS job_id, o_orderpriority AS industry_id FROM orders"


def _job_tables(spark, sf_dir):
    """Customers as postings, order priorities as their industries."""
    jobs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_nationkey").alias("company_id"))
    links = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"), F.col("o_orderpriority").alias("industry_id")).distinct()
    industries = links.select("industry_id").distinct().withColumn("industry_name", F.substring_index("industry_id", "-", -1))
    return jobs, links, industries


@query("j1_denormalize", f"""
SELECT c_custkey AS job_id, c_nationkey AS company_id, industry_id, regexp_replace(industry_id, '^.*-', '') AS industry_name
FROM customer JOIN ({JOB_INDUSTRIES}) ON job_id = c_custkey""")
def j1(spark, sf_dir):
    return j.denormalize_jobs(*_job_tables(spark, sf_dir))


@query("j2_semi", """
SELECT n_nationkey AS company_id, n_name FROM nation
WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def j2(spark, sf_dir):
    companies = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("company_id"), "n_name")
    jobs = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_nationkey").alias("company_id"))
    return j.companies_with_jobs(companies, jobs)


@query("j4_present_in_all", on_graph("""
SELECT name FROM topic WHERE name IN (SELECT dst FROM requires) AND name IN (SELECT dst FROM tagged)"""))
def j4(spark, sf_dir):
    g = proxy_graph(spark, sf_dir)
    return j.present_in_all(g.nodes["Topic"], g.edges["REQUIRES_KNOWLEDGE_OF"], g.edges["IS_TAGGED_WITH"])


@query("j5_only_in", on_graph("SELECT name FROM topic WHERE name IN (SELECT dst FROM tagged) AND name NOT IN (SELECT dst FROM requires)"))
def j5(spark, sf_dir):
    g = proxy_graph(spark, sf_dir)
    return j.only_in(g.nodes["Topic"], g.edges["IS_TAGGED_WITH"], g.edges["REQUIRES_KNOWLEDGE_OF"])


@query("j6_topic_counts", on_graph("""
SELECT name, (SELECT count(*) FROM requires WHERE dst = name) AS jobs, (SELECT count(*) FROM tagged WHERE dst = name) AS posts
FROM topic"""))
def j6(spark, sf_dir):
    g = proxy_graph(spark, sf_dir)
    return j.topic_counts(g.nodes["Topic"], jobs=g.edges["REQUIRES_KNOWLEDGE_OF"], posts=g.edges["IS_TAGGED_WITH"])


@query("f10_count_is_zero", on_graph("SELECT name FROM topic WHERE name NOT IN (SELECT dst FROM requires)"))
def f10(spark, sf_dir):
    g = proxy_graph(spark, sf_dir)
    counts = j.topic_counts(g.nodes["Topic"], jobs=g.edges["REQUIRES_KNOWLEDGE_OF"])
    return counts.where(F.col("jobs") == 0).select("name")


@query("j7_two_hops", on_graph("""
SELECT a.dst, count(*) AS n FROM addresses a JOIN subtopic_of s ON s.src = a.dst GROUP BY a.dst"""))
def j7(spark, sf_dir):
    g = proxy_graph(spark, sf_dir)
    return a.count_by(j.papers_with_subtopic(g.edges["ADDRESSES_TOPIC"], g.edges["SUBTOPIC_OF"]), "dst", name="n")


@query("j8_authors_of_pairs", on_graph("""
SELECT paper, neighbour, 1 AS side, src AS author FROM pairs JOIN authored ON dst = paper
UNION ALL SELECT paper, neighbour, 2, src FROM pairs JOIN authored ON dst = neighbour""", """
pairs AS (SELECT min(eid) AS paper, max(eid) AS neighbour FROM paper p JOIN orders ON o_orderkey = eid GROUP BY o_custkey)"""))
def j8(spark, sf_dir):
    first_last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("paper"), F.max("o_orderkey").alias("neighbour")).drop("o_custkey")
    return j.authors_of_pairs(first_last, proxy_graph(spark, sf_dir).edges["AUTHORED"])


@query("j9_with_totals", """
SELECT n_name, (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers FROM nation""")
def j9(spark, sf_dir):
    return j.with_totals(table(spark, sf_dir, "nation").select("n_name"),
                         customers=table(spark, sf_dir, "customer"), suppliers=table(spark, sf_dir, "supplier"))


@query("j10_restrict_to", on_graph("""
SELECT name FROM topic JOIN (SELECT dst FROM addresses GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 10) ON dst = name"""))
def j10(spark, sf_dir):
    g = proxy_graph(spark, sf_dir)
    top = k.top_n(a.count_by(g.edges["ADDRESSES_TOPIC"], "dst"), [F.desc("count"), "dst"], 10)
    return j.restrict_to(g.nodes["Topic"], top.select(F.col("dst").alias("topic")))


@query("j11_canonicalize", """
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'STANDARD' ELSE p_type END AS p_type FROM part""")
def j11(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    mapping = parts.where(F.col("p_type") == "ECONOMY").select(
        F.col("p_type").alias("name"), F.lit("STANDARD").alias("canonical")).distinct()
    return j.canonicalize(parts, "p_type", mapping)


# --- aggregates -----------------------------------------------------------------------------


@query("a1_node_count", "SELECT count(*) AS n FROM orders")
def a1(spark, sf_dir):
    return a.node_count(table(spark, sf_dir, "orders"))


@query("a2_edge_count", "SELECT d.lang, count(l.doc_id) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.lang")
def a2(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("labelled"))
    docs = table(spark, sf_dir, "documents").join(labels, F.col("doc_id") == F.col("labelled"), "left")
    return a.edge_count_by(docs, "lang", counted="labelled")


@query("a3_count_two_keys", "SELECT p_brand, p_type, count(*) AS count FROM part GROUP BY p_brand, p_type")
def a3(spark, sf_dir):
    return a.count_by(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("a4_sum_over_groups", """
SELECT l_partkey, CAST(sum(n) AS BIGINT) AS total FROM (
  SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_partkey, l_returnflag) GROUP BY l_partkey""")
def a4(spark, sf_dir):
    return a.sum_by(a.count_by(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", name="n"), "l_partkey", "n")


ORDER_YEARS = "SELECT o_custkey, year(o_orderdate) AS year, count(*) AS count FROM orders GROUP BY o_custkey, year(o_orderdate)"


def _order_years(spark, sf_dir):
    return a.count_by(
        table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year")), "o_custkey", "year")


@query("a5_series", f"SELECT o_custkey, string_agg(year || ':' || count, ',' ORDER BY year) AS series FROM ({ORDER_YEARS}) GROUP BY o_custkey")
def a5(spark, sf_dir):
    series = a.collect_series(_order_years(spark, sf_dir), "o_custkey", "year", "count")
    text = F.transform("series", lambda x: F.concat_ws(":", x["year"].cast("string"), x["count"].cast("string")))
    return series.select("o_custkey", F.array_join(text, ",").alias("series"))


@query("a6_distinct_count", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey")
def a6(spark, sf_dir):
    return a.distinct_count_by(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("a7_collect_distinct", """
SELECT l_partkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) AS suppliers, count(*) AS n
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY l_partkey""")
def a7(spark, sf_dir):
    lists = a.collect_distinct_by(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    return lists.select("l_partkey", F.array_join(F.col("values").cast("array<string>"), ",").alias("suppliers"),
                        F.size("values").cast("long").alias("n"))


@query("a8_sum_if", f"""
SELECT o_custkey, CAST(coalesce(sum(count) FILTER (WHERE year = 1996), 0) AS BIGINT) AS n FROM ({ORDER_YEARS}) GROUP BY o_custkey""")
def a8(spark, sf_dir):
    return _order_years(spark, sf_dir).groupBy("o_custkey").agg(a.sum_if(F.col("year") == 1996, "count").alias("n"))


@query("a9_growth", f"""
SELECT *, count_end - count_start AS growth FROM (
  SELECT o_custkey, CAST(coalesce(sum(count) FILTER (WHERE year = 1995), 0) AS BIGINT) AS count_start,
         CAST(coalesce(sum(count) FILTER (WHERE year = 2001), 0) AS BIGINT) AS count_end FROM ({ORDER_YEARS}) GROUP BY o_custkey)""")
def a9(spark, sf_dir):
    return a.growth(_order_years(spark, sf_dir), "o_custkey", "year", "count", 1995, 2001)


@query("a10_exists", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS present FROM customer")
def a10(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return a.exists_by(urgent, table(spark, sf_dir, "customer"), "c_custkey")


@query("a11_distinct", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def a11(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()


@query("a12_children", on_graph("""
SELECT parent, count(*) AS n, string_agg(child, ',' ORDER BY child) AS children FROM hierarchy GROUP BY parent"""))
def a12(spark, sf_dir):
    children = a.children_by_parent(proxy_hierarchy(table(spark, sf_dir, "part")))
    return children.select("parent", F.size("children").cast("long").alias("n"), F.array_join("children", ",").alias("children"))


@query("a13_last_per_key", """
SELECT o_custkey, o_orderkey AS last_order, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def a13(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("last_order"))
    return a.last_per_key(rows, "o_custkey", "o_orderkey").select("o_custkey", "last_order", "o_orderstatus")


# --- ranking and sorting --------------------------------------------------------------------

BY_PRICE = "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey"


def _ranked_orders(spark, sf_dir, n):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = k.top_k_per_key(orders, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], n)
    return top.withColumn("rank", F.col("rank").cast("long"))


@query("w1_top_3", f"SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER ({BY_PRICE}) AS rank FROM orders QUALIFY rank <= 3")
def w1(spark, sf_dir):
    return _ranked_orders(spark, sf_dir, 3)


@query("w2_top_3_array", f"""
SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY rank) AS top FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER ({BY_PRICE}) AS rank FROM orders QUALIFY rank <= 3) GROUP BY o_custkey""")
def w2(spark, sf_dir):
    top = k.top_k_array(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3, ["o_orderkey"])
    return top.select("o_custkey", F.array_join(F.transform("top", lambda x: x["o_orderkey"].cast("string")), ",").alias("top"))


@query("w3_top_10", f"SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER ({BY_PRICE}) AS rank FROM orders QUALIFY rank <= 10")
def w3(spark, sf_dir):
    return _ranked_orders(spark, sf_dir, 10)


@query("o1_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o1(spark, sf_dir):
    return k.top_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 10)


@query("o2_order_by_hidden", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def o2(spark, sf_dir):
    return k.top_n(table(spark, sf_dir, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 10).select("o_orderkey")


@query("o3_full_sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def o3(spark, sf_dir):
    return k.top_n(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], None)


@query("o4_sorted_array", """
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey""")
def o4(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("o5_first_n", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 5")
def o5(spark, sf_dir):
    return k.first_n(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 5)


# --- upserts --------------------------------------------------------------------------------


@query("k6_upsert_nodes", """
SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE c_mktsegment END AS segment,
       CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS balance
FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT -1 - s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def k6(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    old = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    changed = customer.where(F.col("c_mktsegment") == "BUILDING").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("name"), F.col("n_name").alias("segment"),
        F.col("c_acctbal").alias("balance"))
    added = table(spark, sf_dir, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("segment"),
        F.col("s_acctbal").alias("balance"))
    new = changed.unionByName(added)
    once = upsert_nodes(old, new, "id")
    return upsert_nodes(once, new.unionByName(new), "id")


@query("k6_whole_rows", """
SELECT l_partkey AS id, l_suppkey AS supplier, l_returnflag AS flag, l_quantity AS quantity, l_orderkey AS source FROM (
  SELECT *, row_number() OVER (
    PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_suppkey DESC, l_returnflag DESC, l_quantity DESC, l_orderkey DESC) AS r
  FROM lineitem)
WHERE r = 1""")
def k6_whole_rows(spark, sf_dir):
    """Of many new rows of one key the latest is taken as it is."""
    new = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("source"), F.col("l_shipdate").alias("at"))
    return upsert_nodes(None, new, "id", order="at")


@query("k7_upsert_edges", on_graph("SELECT src, dst FROM tagged WHERE src IN (SELECT id FROM post) AND dst IN (SELECT dst FROM requires)"))
def k7(spark, sf_dir):
    g = proxy_graph(spark, sf_dir)
    tagged = g.edges["IS_TAGGED_WITH"]
    topics = g.edges["REQUIRES_KNOWLEDGE_OF"].select("dst").distinct()
    return upsert_edges(None, tagged.unionByName(tagged), g.nodes["StackOverflowPost"], topics)


@query("k8_upsert_edge_property", """
SELECT l_suppkey AS src, l_partkey AS dst, coalesce(max(l_quantity) FILTER (WHERE l_returnflag = 'R'), max(l_quantity)) AS weight
FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY l_suppkey, l_partkey""")
def k8(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("weight"), "l_returnflag")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    parts = table(spark, sf_dir, "part").select("p_partkey")
    old = upsert_edges(None, lines.where(F.col("l_returnflag") == "A"), suppliers, parts, props=["weight"])
    return upsert_edges(old, lines.where(F.col("l_returnflag") == "R"), suppliers, parts, props=["weight"])


@query("k9_hierarchy_to_graph", on_graph("""
SELECT 'topic' AS kind, name AS src, '' AS dst FROM topic UNION ALL SELECT 'edge', src, dst FROM subtopic_of"""))
def k9(spark, sf_dir):
    topics, edges = hierarchy_to_graph(proxy_hierarchy(table(spark, sf_dir, "part")))
    return topics.select(F.lit("topic").alias("kind"), F.col("name").alias("src"), F.lit("").alias("dst")).unionByName(
        edges.select(F.lit("edge").alias("kind"), "src", "dst"))
