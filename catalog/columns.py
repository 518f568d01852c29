"""Column shaping, predicates and scalar functions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, rounded
from topicloom.functions import columns as c
from topicloom.functions import predicates as p
from topicloom.plans.proxy import table, text_table

# --- projection -----------------------------------------------------------------------------


@query("p1_normalize_names", "SELECT c_custkey AS cust_key, c_name AS full_name, c_mktsegment AS market_segment FROM customer")
def p1(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.normalize_column_names(raw.toDF(" Cust Key", "Full-Name ", "Market Segment"))


@query("p2_snake_case", "SELECT event_id AS id, event_type AS post_type_id, user_id AS owner_user_id FROM events")
def p2(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return c.snake_case_columns(raw.toDF("_Id", "_PostTypeId", "_OwnerUserId"))


@query("p3_select_rename_drop", "SELECT p_partkey AS part, p_name AS name FROM part")
def p3(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), "p_type").drop(
        "p_type", "no_such_column"
    )


@query("p4_to_long", """
SELECT c_custkey, TRY_CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' || c_nationkey ELSE '' || c_nationkey END AS BIGINT) AS nation
FROM customer""")
def p4(spark, sf_dir):
    text = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "x").otherwise(""), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", c.to_long(text).alias("nation"))


@query("p4_decimal_text", """
SELECT c_custkey, c_nationkey::BIGINT AS nation, CAST(trunc(c_acctbal) AS BIGINT) AS balance FROM customer""")
def p4_decimal_text(spark, sf_dir):
    """Ids written as decimals keep their whole part; so does any decimal text."""
    key = F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", c.to_long(key).alias("nation"), c.to_long(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("balance"))


@query("p5_computed", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem")
def p5(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    )


# --- predicates -----------------------------------------------------------------------------

LABELLED = "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


def _labelled(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("f1_not_null", f"SELECT * FROM ({LABELLED}) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def f1(spark, sf_dir):
    return p.not_null(_labelled(spark, sf_dir), "quality", "toxic")


@query("f2_dropna", f"SELECT * FROM ({LABELLED}) WHERE quality IS NOT NULL")
def f2(spark, sf_dir):
    return _labelled(spark, sf_dir).dropna(subset=["quality"])


@query("f3_years_in", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (1995, 1999, 2000, 2001)")
def f3(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(p.years_in("o_orderdate", [1995, 1999, 2000, 2001])).select("o_orderkey")


@query("f4_in_list", "SELECT p_partkey, p_size FROM part WHERE p_size IN (7, 21, 40)")
def f4(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_size").isin(7, 21, 40)).select("p_partkey", "p_size")


@query("f5_not_equal", f"SELECT * FROM ({LABELLED}) WHERE quality <> 1")
def f5(spark, sf_dir):
    return _labelled(spark, sf_dir).where(F.col("quality") != 1)


@query("f6_has_word", r"""
SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, '(?i)\b(building|machinery)\b')""")
def f6(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(p.has_word("c_mktsegment", ["building", "machinery"])).select(
        "c_custkey", "c_mktsegment"
    )


@query("f7_drop_containing", """
SELECT p_partkey, p_name FROM part WHERE NOT (contains(p_name, 'ring') OR contains(p_name, 'blue') OR contains(p_name, 'small'))""")
def f7(spark, sf_dir):
    return p.drop_containing(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["ring", "blue", "small"])


@query("f8_non_empty", r"""
SELECT * FROM (SELECT p_partkey, regexp_extract(p_name, '^(red|blue)', 1) AS colour, regexp_extract(p_name, '(\S+)$', 1) AS thing FROM part)
WHERE colour <> '' AND thing <> ''""")
def f8(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.regexp_extract("p_name", "^(red|blue)", 1).alias("colour"),
        F.regexp_extract("p_name", r"(\S+)$", 1).alias("thing"),
    )
    return parts.where(p.non_empty("colour", "thing"))


@query("f9_thresholds", "SELECT event_id, value, value > 30.0 AS over FROM events WHERE value >= 10.0")
def f9(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("value") >= 10.0).select(
        "event_id", "value", (F.col("value") > 30.0).alias("over")
    )


@query("f11_drop_self_edges", """
SELECT DISTINCT l_linenumber AS parent, CAST(l_quantity AS INTEGER) AS child FROM lineitem
WHERE l_linenumber <> CAST(l_quantity AS INTEGER)""")
def f11(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("parent"), F.col("l_quantity").cast("int").alias("child"))
    return p.drop_self_edges(edges)


@query("f12_predicate_kind", """
SELECT p_partkey, CASE WHEN p_size = 50 THEN 'preferentialEquivalent' WHEN p_size = 49 THEN 'relatedEquivalent'
                       WHEN p_size <= 25 THEN 'superTopicOf' END AS kind FROM part""")
def f12(spark, sf_dir):
    size = F.col("p_size")
    address = F.concat(F.lit("<http://schema.example/ns#"), F.when(size == 50, "preferentialEquivalent")
                       .when(size == 49, "relatedEquivalent").when(size <= 25, "superTopicOf").otherwise("label"), F.lit(">"))
    return table(spark, sf_dir, "part").select("p_partkey", p.predicate_kind(address).alias("kind"))


@query("f13_with_topic", "SELECT p_partkey, p_brand AS topic FROM part WHERE p_size > 10")
def f13(spark, sf_dir):
    address = F.concat(F.when(F.col("p_size") > 10, "<https://x.example/topics/").otherwise("<https://x.example/other/"),
                       F.col("p_brand"), F.lit(">"))
    slugs = table(spark, sf_dir, "part").select("p_partkey", c.topic_slug(address).alias("topic"))
    return slugs.where(p.non_empty("topic"))


@query("f14_maybe_year", """
SELECT 'one' AS run, o_orderkey FROM orders WHERE year(o_orderdate) = 1999
UNION ALL SELECT 'all', o_orderkey FROM orders""")
def f14(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return p.maybe_year(orders, "year", 1999).select(F.lit("one").alias("run"), "o_orderkey").unionByName(
        p.maybe_year(orders, "year").select(F.lit("all").alias("run"), "o_orderkey"))


# --- scalar functions -----------------------------------------------------------------------


@query("x1_split_explode", r"""
SELECT doc_id, trim(part) AS part FROM (SELECT doc_id, unnest(string_split(text, '.')) AS part FROM documents)
WHERE regexp_replace(part, '^\s+|\s+$', '', 'g') <> ''""".replace(
    "trim(part)", r"regexp_replace(part, '^\s+|\s+$', '', 'g')"))
def x1(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", F.explode(c.split_clean("text", ".")).alias("part"))


@query("x2_explode", "SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def x2(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("x"))


@query("x3_strip", r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM documents")
def x3(spark, sf_dir):
    padded = F.concat(F.lit(" \t\n"), F.col("text"), F.lit("\n "))
    return text_table(spark, sf_dir, "documents").select("doc_id", F.length(c.strip(padded)).cast("long").alias("n"))


@query("x4_author_affiliation", """
SELECT c_custkey, c_name AS author, n_name || ', ' || c_mktsegment AS affiliation
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def x4(spark, sf_dir):
    entry = F.concat_ws(", ", "c_name", "n_name", "c_mktsegment")
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", c.author_of(entry).alias("author"), c.affiliation_of(entry).alias("affiliation"))


@query("x5_topic_slug", "SELECT page_id, regexp_extract(url, '/([^/]+)$', 1) AS slug FROM pages")
def x5(spark, sf_dir):
    last = F.regexp_extract("url", "/([^/]+)$", 1)
    address = F.concat(F.lit("<https://x.example/topics/"), last, F.lit(">"))
    return text_table(spark, sf_dir, "pages").select("page_id", c.topic_slug(address).alias("slug"))


@query("x6_tags", "SELECT p_partkey, replace(p_name, ' ', ',') AS tags FROM part")
def x6(spark, sf_dir):
    tags = F.concat(F.lit("<"), F.replace("p_name", F.lit(" "), F.lit("><")), F.lit(">"))
    return table(spark, sf_dir, "part").select("p_partkey", c.tags_to_csv(tags).alias("tags"))


@query("x7_year", "SELECT o_orderkey, year(o_orderdate) AS year FROM orders")
def x7(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))


@query("x8_lower", "SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer")
def x8(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_mktsegment").alias("segment"))


@query("x9_join_text", """
SELECT d.doc_id, d.source || chr(10) || coalesce(quality::VARCHAR, '') || chr(10) || d.lang AS text
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def x9(spark, sf_dir):
    docs = text_table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", c.join_text("source", F.col("quality").cast("string"), "lang").alias("text"))


@query("x10_array_join", "SELECT p_partkey, p_brand || ', ' || p_type AS joined FROM part")
def x10(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", c.joined(F.array("p_brand", "p_type")).alias("joined"))


@query("x11_first_items", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS start FROM documents")
def x11(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select(
        "doc_id", c.joined(c.first_items(F.split("text", " "), 5), " ").alias("start"))


@query("x12_size", "SELECT doc_id, len(string_split(text, ' ')) AS words FROM documents")
def x12(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("words"))


@query("x13_round", f"SELECT event_id, {rounded('value', 1)} AS one, {rounded('value / 7', 3)} AS three FROM events")
def x13(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", c.round_half_up("value", 1).alias("one"), c.round_half_up(F.col("value") / 7, 3).alias("three"))


@query("x14_pct", f"""
SELECT o_custkey, {rounded("100.0 * count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*)", 4)} AS share,
       CAST(NULL AS DOUBLE) AS of_nothing FROM orders GROUP BY o_custkey""")
def x14(spark, sf_dir):
    closed = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        c.round_half_up(c.pct(closed, F.count("*")), 4).alias("share"), c.pct(closed, F.lit(0)).alias("of_nothing"))


@query("x15_struct_field", "SELECT p_partkey, p_name AS title, p_size AS n FROM part")
def x15(spark, sf_dir):
    record = F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("n"))
    return table(spark, sf_dir, "part").select("p_partkey", record.alias("r")).select("p_partkey", "r.title", "r.n")


@query("x16_array_sum_where", """
SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'N') AS total FROM lineitem GROUP BY l_orderkey""")
def x16(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    series = counted.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "n")).alias("flags"))
    return series.select(
        "l_orderkey", c.array_sum_where("flags", lambda x: x["l_returnflag"] != "N", "n").alias("total"))


@query("x17_item_at", "SELECT doc_id, string_split(text, ' ')[4] AS word FROM documents")
def x17(spark, sf_dir):
    return text_table(spark, sf_dir, "documents").select("doc_id", c.item_at(F.split("text", " "), 3).alias("word"))


@query("x18_sqrt", "SELECT o_orderkey, sqrt(o_totalprice) AS root FROM orders")
def x18(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sqrt("o_totalprice").alias("root"))


@query("x19_blank_if_null", f"SELECT doc_id, coalesce(quality::VARCHAR, '') AS quality FROM ({LABELLED})")
def x19(spark, sf_dir):
    return _labelled(spark, sf_dir).select("doc_id", c.blank_if_null(F.col("quality").cast("string")).alias("quality"))


@query("x20_field_of_map", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def x20(spark, sf_dir):
    props = F.from_json("props", "map<string,bigint>")
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(props, F.lit("k")).alias("k"))
