"""Graph jobs and entity pipelines on the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.questions import FULL_GRAPH, JACCARD, nearest, rank_rounds
from catalog.registry import on_graph, query, rounded
from catalog.relational import JOB_INDUSTRIES, _job_tables
from catalog.texts import (
    CLASSIFIED, TERM_TREE, WORDS, benchmark_terms, clean_sql, embedded_sql, term_tree,
)
from topicloom.constants import PREDICATE_KINDS
from topicloom.functions.columns import round_half_up
from topicloom.graph.betweenness import betweenness, betweenness_within
from topicloom.graph.communities import leiden, louvain, settled
from topicloom.graph.components import symmetric
from topicloom.graph.hubs import hubs
from topicloom.graph.ontology import canonical_hierarchy, descendants
from topicloom.graph.pagerank import pagerank
from topicloom.graph.projection import project_graph
from topicloom.graph.similarity import node_similarity
from topicloom.operators.classify import vocabulary
from topicloom.operators.encode import embed
from topicloom.plans import pipelines
from topicloom.plans.proxy import proxy_graph, proxy_hierarchy, table, text_table
from topicloom.runtime import has_at_most

# --- ontology -------------------------------------------------------------------------------


def proxy_triples(spark, sf_dir) -> DataFrame:
    """The proxy hierarchy as addresses, with preferred and equivalent names by part size."""
    part = table(spark, sf_dir, "part")
    name = lambda key: F.concat(F.lit("part_"), key.cast("string"))
    key = F.col("p_partkey")
    named = lambda df, a, kind, b: df.select(a.alias("a"), F.lit(kind).alias("kind"), b.alias("b"))
    above, related, preferred = PREDICATE_KINDS
    rows = (
        named(proxy_hierarchy(part), F.col("parent"), above, F.col("child"))
        .unionByName(named(part.where(F.col("p_size") == 50), name(key), preferred, name(key - 1)))
        .unionByName(named(part.where(F.col("p_size") == 49), name(key), related, name(key + 1)))
    )
    address = lambda c: F.concat(F.lit(" <https://x.example/topics/"), F.col(c), F.lit("> "))
    return rows.select(address("a").alias("subj"), F.concat(F.lit("<https://x.example/schema#"), "kind", F.lit(">")).alias("pred"),
                       address("b").alias("obj"))


CANONICAL = """
preferred AS (SELECT 'part_' || p_partkey AS name, 'part_' || (p_partkey - 1) AS pref FROM part WHERE p_size = 50),
related AS (
  SELECT 'part_' || p_partkey AS a, 'part_' || (p_partkey + 1) AS b FROM part WHERE p_size = 49
  UNION SELECT 'part_' || (p_partkey + 1), 'part_' || p_partkey FROM part WHERE p_size = 49
),
reach AS (SELECT a, a AS b FROM related UNION SELECT r.a, e.b FROM reach r JOIN related e ON e.a = r.b),
members AS (SELECT a AS name, min(b) AS component FROM reach GROUP BY a),
cluster AS (SELECT component, min(pref) AS pref FROM members JOIN preferred USING (name) GROUP BY component),
canonical AS (
  SELECT coalesce(m.name, p.name) AS name, coalesce(p.pref, c.pref, m.component) AS canonical
  FROM members m FULL JOIN preferred p ON p.name = m.name LEFT JOIN cluster c ON c.component = m.component
),
clean AS (
  SELECT DISTINCT coalesce(x.canonical, h.parent) AS parent, coalesce(y.canonical, h.child) AS child
  FROM hierarchy h LEFT JOIN canonical x ON x.name = h.parent LEFT JOIN canonical y ON y.name = h.child
  WHERE coalesce(x.canonical, h.parent) <> coalesce(y.canonical, h.child)
)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("g1_canonical_hierarchy", _recursive(on_graph("SELECT parent, child FROM clean", CANONICAL)))
def g1_canonical_hierarchy(spark, sf_dir):
    return canonical_hierarchy(proxy_triples(spark, sf_dir))


@query("g2_descendants", on_graph("SELECT topic, CAST(min(depth) AS INTEGER) AS depth FROM below GROUP BY topic", """
below AS (
  SELECT child AS topic, 1 AS depth FROM hierarchy WHERE parent = 'catalog'
  UNION ALL SELECT b.child, 2 FROM hierarchy a JOIN hierarchy b ON b.parent = a.child WHERE a.parent = 'catalog'
  UNION ALL SELECT c.child, 3 FROM hierarchy a JOIN hierarchy b ON b.parent = a.child JOIN hierarchy c ON c.parent = b.child
  WHERE a.parent = 'catalog'
)"""))
def g2_descendants(spark, sf_dir):
    return descendants(proxy_hierarchy(table(spark, sf_dir, "part")), "catalog", 3)


# --- algorithms -----------------------------------------------------------------------------


@query("g3_project_graph", on_graph("""
SELECT src, dst, 'REQUIRES_KNOWLEDGE_OF' AS type FROM (
  SELECT 'JobRole:' || src AS src, 'Topic:' || dst AS dst FROM requires UNION SELECT 'Topic:' || dst, 'JobRole:' || src FROM requires)
UNION ALL SELECT src, dst, 'IS_TAGGED_WITH' FROM (
  SELECT 'StackOverflowPost:' || src AS src, 'Topic:' || dst AS dst FROM tagged
  UNION SELECT 'Topic:' || dst, 'StackOverflowPost:' || src FROM tagged)"""))
def g3_project_graph(spark, sf_dir):
    _, edges = project_graph(
        proxy_graph(spark, sf_dir), ["Topic", "JobRole", "StackOverflowPost"],
        ["REQUIRES_KNOWLEDGE_OF", "IS_TAGGED_WITH", "AUTHORED"])
    return edges


SIMILAR = f"SELECT node, neighbour, {rounded('similarity', 6)} AS similarity, rank FROM nearest"


def _similar(df):
    return df.withColumns({"similarity": round_half_up("similarity", 6), "rank": F.col("rank").cast("long")})


@query("g4_node_similarity", on_graph(SIMILAR, JACCARD, nearest(0.0, 10)))
def g4_node_similarity(spark, sf_dir):
    return _similar(node_similarity(proxy_graph(spark, sf_dir).edges["ADDRESSES_TOPIC"]))


@query("g4_node_similarity_frequent", on_graph(SIMILAR, JACCARD, nearest(0.2, 5)))
def g4_node_similarity_frequent(spark, sf_dir):
    """The same measure with most topics treated as frequent."""
    edges = proxy_graph(spark, sf_dir).edges["ADDRESSES_TOPIC"]
    return _similar(node_similarity(edges, top_k=5, cutoff=0.2, hot_degree=28, hot_width=5))


@query("g5_pagerank", on_graph(f"SELECT id, {rounded('r * 1000', 6)} AS pagerank FROM rank_20",
                               "ids AS (SELECT name AS id FROM topic)", rank_rounds("ids", "subtopic_of")))
def g5_pagerank(spark, sf_dir):
    g = proxy_graph(spark, sf_dir)
    ranks = pagerank(g.nodes["Topic"].select(F.col("name").alias("id")), g.edges["SUBTOPIC_OF"])
    return ranks.select("id", round_half_up(F.col("rank") * 1000, 6).alias("pagerank"))


@query("g6_louvain", on_graph("SELECT name AS node, true AS settled, true AS named FROM topic WHERE name IN (SELECT src FROM subtopic_of UNION SELECT dst FROM subtopic_of)"))
def g6_louvain(spark, sf_dir):
    """Every topic, and whether its community is one that no move improves and is named by its smallest member."""
    edges = proxy_graph(spark, sf_dir).edges["SUBTOPIC_OF"]
    return settled(edges, louvain(edges)).select("node", "settled", "named")


@query("g7_leiden", on_graph("SELECT name AS node, true AS settled, true AS connected, true AS named FROM topic WHERE name IN (SELECT src FROM subtopic_of UNION SELECT dst FROM subtopic_of)"))
def g7_leiden(spark, sf_dir):
    """As for Louvain, and whether the community is in one piece."""
    edges = proxy_graph(spark, sf_dir).edges["SUBTOPIC_OF"]
    return settled(edges, leiden(edges))


CLIQUES = """
members AS (SELECT p_partkey AS id, p_brand AS brand, min(p_partkey) OVER (PARTITION BY p_brand) AS head FROM part)"""


def _clique_edges(spark, sf_dir) -> DataFrame:
    """Parts of one brand all joined with each other; the first parts of brands joined in a row by single bridges."""
    part = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("src"))
    # Dealt by part, since a task that holds a brand makes all of its pairs.
    dealt = part.repartition(8 * spark.sparkContext.defaultParallelism, "src")
    lists = part.groupBy("p_brand").agg(F.collect_list("src").alias("others"))
    lists = F.broadcast(lists) if has_at_most(part, 4_000_000) else lists
    inside = dealt.join(lists, "p_brand").select("src", F.explode("others").alias("dst")).where("src < dst")
    heads = part.groupBy("p_brand").agg(F.min("src").alias("src"))
    nearest = heads.withColumnRenamed("src", "dst").withColumnRenamed("p_brand", "other")
    bridges = heads.join(nearest, F.col("other") > F.col("p_brand")).groupBy("p_brand").agg(
        F.first("src").alias("src"), F.min_by("dst", "other").alias("dst")).select("src", "dst")
    return inside.unionByName(bridges)


@query("g6_louvain_cliques", f"WITH {CLIQUES} SELECT id AS node, head AS community FROM members")
def g6_louvain_cliques(spark, sf_dir):
    return louvain(_clique_edges(spark, sf_dir))


@query("g7_leiden_cliques", f"WITH {CLIQUES} SELECT id AS node, head AS community FROM members")
def g7_leiden_cliques(spark, sf_dir):
    return leiden(_clique_edges(spark, sf_dir))


def brandes_sql(edges: str, sources: str, levels: int, scale: float) -> str:
    """Brandes' method unrolled: levels of (source, node, paths), then deltas backwards."""
    parts = [f"level_0 AS MATERIALIZED (SELECT id AS source, id AS node, 1.0::DOUBLE AS paths FROM {sources})"]
    for i in range(1, levels + 1):
        before = " ".join(
            f"AND NOT EXISTS (SELECT 1 FROM level_{d} b WHERE b.source = l.source AND b.node = e.dst)" for d in range(i))
        parts.append(f"""level_{i} AS MATERIALIZED (
  SELECT l.source, e.dst AS node, sum(l.paths) AS paths FROM level_{i - 1} l JOIN {edges} e ON e.src = l.node
  WHERE true {before} GROUP BY l.source, e.dst)""")
    parts.append(f"delta_{levels} AS (SELECT source, node, paths, 0.0::DOUBLE AS delta FROM level_{levels})")
    for i in range(levels - 1, -1, -1):
        parts.append(f"""delta_{i} AS MATERIALIZED (
  SELECT l.source, l.node, l.paths, l.paths * coalesce(g.given, 0.0) AS delta FROM level_{i} l LEFT JOIN (
    SELECT d.source, e.src AS node, sum((1.0 + d.delta) / d.paths) AS given
    FROM delta_{i + 1} d JOIN {edges} e ON e.dst = d.node GROUP BY d.source, e.src
  ) g ON g.source = l.source AND g.node = l.node)""")
    union = " UNION ALL ".join(f"SELECT source, node, delta FROM delta_{i}" for i in range(levels + 1))
    parts.append(f"""between AS (
  SELECT name AS id, coalesce(d, 0.0) * {scale} AS betweenness FROM topic
  LEFT JOIN (SELECT node, sum(delta) AS d FROM ({union}) WHERE source <> node GROUP BY node) ON node = name)""")
    return ",\n".join(parts).replace("between AS (", "centrality AS (")


@query("g8_betweenness", on_graph(f"SELECT id, {rounded('betweenness', 4)} AS betweenness FROM centrality",
                                  "ids AS (SELECT name AS id FROM topic)", brandes_sql("subtopic_of", "ids", 3, 1.0)))
def g8_betweenness(spark, sf_dir):
    g = proxy_graph(spark, sf_dir)
    found = betweenness(g.nodes["Topic"].select(F.col("name").alias("id")), g.edges["SUBTOPIC_OF"])
    return found.withColumn("betweenness", round_half_up("betweenness", 4))


@query("g8_betweenness_from_16", on_graph(
    f"SELECT id, {rounded('betweenness', 4)} AS betweenness FROM centrality",
    "ids AS (SELECT name AS id FROM topic ORDER BY md5('0:' || name), name LIMIT 16)",
    "around AS (SELECT src, dst FROM subtopic_of UNION SELECT dst, src FROM subtopic_of)",
    brandes_sql("around", "ids", 6, 0.5)))
def g8_betweenness_from_16(spark, sf_dir):
    """The undirected measure with shortest paths from 16 drawn topics."""
    g = proxy_graph(spark, sf_dir)
    ids = g.nodes["Topic"].select(F.col("name").alias("id"))
    found = betweenness(ids, symmetric(g.edges["SUBTOPIC_OF"]), sources=16, directed=False)
    return found.withColumn("betweenness", round_half_up("betweenness", 4))


@query("g8_betweenness_in_words", on_graph(f"SELECT id, {rounded('betweenness', 4)} AS betweenness, 0.0::DOUBLE AS bound FROM centrality",
                                           "ids AS (SELECT name AS id FROM topic)", brandes_sql("subtopic_of", "ids", 3, 1.0)))
def g8_betweenness_in_words(spark, sf_dir):
    """No error is allowed, so all topics are drawn, 64 to a row."""
    g = proxy_graph(spark, sf_dir)
    found = betweenness_within(g.nodes["Topic"].select(F.col("name").alias("id")), g.edges["SUBTOPIC_OF"], error=0.0)
    return found.withColumn("betweenness", round_half_up("betweenness", 4))


@query("g8_betweenness_within", on_graph(
    f"SELECT id, {rounded('betweenness', 4)} AS betweenness, true AS within FROM centrality", "ids AS (SELECT name AS id FROM topic)",
    "around AS (SELECT src, dst FROM subtopic_of UNION SELECT dst, src FROM subtopic_of)", brandes_sql("around", "ids", 6, 0.5)))
def g8_betweenness_within(spark, sf_dir):
    """The undirected measure, and whether the estimate from drawn topics is within its stated bound and the error allowed."""
    g = proxy_graph(spark, sf_dir)
    ids, links = g.nodes["Topic"].select(F.col("name").alias("id")), symmetric(g.edges["SUBTOPIC_OF"])
    allowed, n = 0.1, ids.distinct().count()
    drawn = betweenness_within(ids, links, error=allowed, directed=False).withColumnRenamed("betweenness", "estimate")
    off = F.abs(F.col("estimate") - F.col("betweenness"))
    within = (off <= F.col("bound") + 1e-6) & (F.col("bound") <= allowed * (n - 1) * (n - 2) / 2)
    both = betweenness(ids, links, directed=False).join(drawn, "id")
    return both.select("id", round_half_up("betweenness", 4).alias("betweenness"), within.alias("within"))


@query("g9_hubs", on_graph(f"SELECT label, key, degree, {rounded('r * 1000', 6)} AS pagerank FROM full_degree JOIN rank_20 USING (id)",
                           FULL_GRAPH, rank_rounds("full_degree", "full_edges")))
def g9_hubs(spark, sf_dir):
    scored = hubs(proxy_graph(spark, sf_dir), k=None)
    return scored.withColumn("pagerank", round_half_up(F.col("pagerank") * 1000, 6))


@query("g9_hubs_by_pagerank", on_graph(
    f"""SELECT label, key, {rounded('r * 1000', 6)} AS pagerank, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(r, 13) DESC, key) AS rank FROM full_degree JOIN rank_20 USING (id))
WHERE rank <= 5""", FULL_GRAPH, rank_rounds("full_degree", "full_edges")))
def g9_hubs_by_pagerank(spark, sf_dir):
    ranked = hubs(proxy_graph(spark, sf_dir), k=5, by="pagerank", measures=())
    return ranked.withColumns({"pagerank": round_half_up(F.col("pagerank") * 1000, 6), "rank": F.col("rank").cast("long")})


# --- entities -------------------------------------------------------------------------------


def _stacked(graph) -> DataFrame:
    """All pieces of a graph as rows ``kind, a, b``."""
    def two(kind: str, df: DataFrame, a: str, b: str | None = None) -> DataFrame:
        second = F.col(b).cast("string") if b else F.lit("")
        return df.select(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a"), second.alias("b"))

    shown = {"Paper": ("eid", "title"), "Job": ("job_id", "industry_name"), "Company": ("company_id", "n_name")}
    nodes = [two(k, df, *shown.get(k, (df.columns[0],))) for k, df in graph.nodes.items()]
    edges = [two(k, df, "src", "dst") for k, df in graph.edges.items()]
    return reduce(DataFrame.unionByName, nodes + edges)


@query("e1_papers", """
WITH raw AS (
  SELECT o_orderkey::VARCHAR AS eid, 'order_' || o_orderkey AS title, c_name AS first, n_name || ', ' || c_mktsegment AS aff,
         'Clerk ' || o_orderpriority AS second, n_name
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)
SELECT 'Paper' AS kind, eid AS a, title AS b FROM raw
UNION ALL SELECT DISTINCT 'Author', author, '' FROM (SELECT first AS author FROM raw UNION SELECT second FROM raw)
UNION ALL SELECT DISTINCT 'Affiliation', aff, '' FROM (SELECT aff FROM raw UNION SELECT n_name FROM raw)
UNION ALL SELECT DISTINCT 'AUTHORED', first, eid FROM raw UNION ALL SELECT DISTINCT 'AUTHORED', second, eid FROM raw
UNION ALL SELECT DISTINCT 'AFFILIATED_WITH', first, aff FROM raw UNION ALL SELECT DISTINCT 'AFFILIATED_WITH', second, n_name FROM raw""")
def e1_papers(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    joined = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(
        t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    clerk = F.concat(F.lit("Clerk "), F.col("o_orderpriority"))
    raw = joined.select(
        F.col("o_orderkey").cast("string").alias("EID"), F.concat(F.lit("order_"), "o_orderkey").alias("Title"),
        F.year("o_orderdate").alias("Year"), F.concat_ws("; ", "c_name", clerk).alias("Authors"),
        F.concat_ws("; ", F.concat_ws(", ", "c_name", "n_name", "c_mktsegment"), F.concat_ws(", ", clerk, "n_name"))
        .alias("Authors with affiliations"))
    return _stacked(pipelines.papers_pipeline(raw))


@query("e2_jobs", rf"""
WITH inds AS ({JOB_INDUSTRIES}),
jobs AS (
  SELECT c_custkey AS job_id, CASE WHEN c_acctbal >= 0 THEN c_nationkey::BIGINT END AS company_id,
         lower(c_mktsegment) || ' clerk' AS role, regexp_replace(industry_id, '^.*-', '') AS industry_name
  FROM customer JOIN inds ON job_id = c_custkey WHERE regexp_matches(industry_id, '(?i)\b(urgent|high)\b')
)
SELECT 'Job' AS kind, job_id::VARCHAR AS a, max(industry_name) AS b FROM jobs GROUP BY job_id
UNION ALL SELECT DISTINCT 'JobRole', role, '' FROM jobs
UNION ALL SELECT DISTINCT 'Company', company_id::VARCHAR, n_name FROM jobs JOIN nation ON n_nationkey = company_id
UNION ALL SELECT DISTINCT 'HAS_ROLE', job_id::VARCHAR, role FROM jobs
UNION ALL SELECT DISTINCT 'POST', company_id::VARCHAR, job_id::VARCHAR FROM jobs WHERE company_id IS NOT NULL""")
def e2_jobs(spark, sf_dir):
    _, links, industries = _job_tables(spark, sf_dir)
    companies = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("company_id"), "n_name")
    postings = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("job_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("string")).otherwise("unknown").alias("company_id"),
        F.concat(F.lit("Senior "), "c_mktsegment", F.lit(" Lead  Clerk")).alias("title"))
    return _stacked(pipelines.jobs_pipeline(companies, industries, links, postings, words=["urgent", "high"]))


POSTS = r"""
(SELECT conv_id * 1000 + turn AS id, role, o_orderstatus, year(o_orderdate) AS year, '<p>' || text || '</p> see http://x.example/' || turn AS html
 FROM conversations JOIN orders ON o_orderkey = conv_id
 WHERE role <> 'assistant' AND year(o_orderdate) IN (1995, 1999, 2000, 2001)) kept"""


@query("e3_posts", f"""
SELECT id, 1::BIGINT AS post_type_id, year, body, role || ',' || o_orderstatus AS tags
FROM ({clean_sql('html', POSTS, 'id, role, o_orderstatus, year')})""")
def e3_posts(spark, sf_dir):
    joined = text_table(spark, sf_dir, "conversations").join(table(spark, sf_dir, "orders"), F.col("conv_id") == F.col("o_orderkey"))
    raw = joined.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("_Id"),
        F.when(F.col("role") == "assistant", 2).otherwise(1).alias("_PostTypeId"), F.col("o_orderdate").alias("_CreationDate"),
        F.concat(F.lit("<p>"), "text", F.lit("</p> see http://x.example/"), F.col("turn").cast("string")).alias("_Body"),
        F.concat(F.lit("<"), "role", F.lit("><"), "o_orderstatus", F.lit(">")).alias("_Tags"))
    posts = pipelines.posts_pipeline(raw, years=[1995, 1999, 2000, 2001]).nodes["StackOverflowPost"]
    return posts.select("id", F.col("post_type_id").cast("long").alias("post_type_id"),
                        F.year("creation_date").cast("long").alias("year"), "body", "tags")


@query("e4_ontology", _recursive(on_graph("""
SELECT DISTINCT 'Topic' AS kind, name AS a, '' AS b FROM (SELECT parent AS name FROM clean UNION SELECT child FROM clean)
UNION ALL SELECT 'SUBTOPIC_OF', child, parent FROM clean""", CANONICAL)))
def e4_ontology(spark, sf_dir):
    return _stacked(pipelines.ontology_pipeline(proxy_triples(spark, sf_dir)))


@query("e5_paper_topics", f"""WITH {WORDS}, {TERM_TREE}, {CLASSIFIED}
SELECT doc_id AS src, topic AS dst FROM (
  SELECT doc_id, topic, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS rank FROM scores QUALIFY rank <= 5)
WHERE topic IN (SELECT name FROM terms)""")
def e5_paper_topics(spark, sf_dir):
    terms = benchmark_terms(spark, sf_dir)
    papers = text_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("eid"), F.col("source").alias("title"), F.col("text").alias("abstract"), F.lit("").alias("keywords"))
    return pipelines.paper_topics_pipeline(papers, vocabulary(terms), term_tree(terms), terms)


@query("e5_classified_layer", "SELECT p_partkey AS src, 'Brand_' || substr(p_brand, 7) AS dst FROM part "
                              "UNION SELECT p_partkey, 'type_' || p_type FROM part")
def e5_classified_layer(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    brand = F.concat(F.lit("Brand_"), F.substring("p_brand", 7, 9))
    kind = F.concat(F.lit("type_"), "p_type")
    layer = part.select(F.col("p_partkey").alias("eid"), F.concat_ws(", ", "p_brand", F.replace(kind, F.lit("_"), F.lit(" ")), F.lit("nothing known")).alias("result_cso"))
    topics = part.select(F.explode(F.array(brand, kind)).alias("name")).distinct()
    return pipelines.classified_to_edges(layer, part.select(F.col("p_partkey").alias("eid")), topics)


@query("e6_topic_vectors", on_graph(f"SELECT name AS topic, i, {rounded('x', 5)} AS x FROM word_vectors", """
scoped AS (SELECT name FROM topic WHERE name <> 'catalog' AND NOT contains(name, 'Brand') AND NOT contains(name, 'ECONOMY'))""",
    embedded_sql("name", "scoped", "name", 384)))
def e6_topic_vectors(spark, sf_dir):
    edges = proxy_hierarchy(table(spark, sf_dir, "part"))
    vectors = pipelines.topic_vectors_pipeline(edges, root="catalog", stop=["Brand", "ECONOMY"])
    places = vectors.select("topic", F.posexplode("embedding").alias("i", "x")).where(F.col("x") != 0)
    return places.select("topic", F.col("i").cast("long").alias("i"), round_half_up(F.col("x").cast("double"), 5).alias("x"))


@query("e7_role_links", f"""WITH
texts AS (SELECT DISTINCT 'name:' || p_name AS id, p_name AS t FROM part
          UNION SELECT DISTINCT 'word:' || w, w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)),
{embedded_sql('id', 'texts', 't', 384)},
pairs AS (
  SELECT substr(a.id, 6) AS src, substr(b.id, 6) AS dst, sum(a.x * b.x) AS sim FROM word_vectors a JOIN word_vectors b ON a.i = b.i
  WHERE a.id LIKE 'name:%' AND b.id LIKE 'word:%' GROUP BY a.id, b.id
)
SELECT src, dst, {rounded('sim', 5)} AS cosine_similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM pairs WHERE sim >= 0.4 QUALIFY rank <= 3)""")
def e7_role_links(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("job_title"))
    words = names.select(F.explode(F.split("job_title", " ")).alias("topic")).distinct()
    edges = pipelines.link_pipeline(
        embed(names.distinct(), "job_title"), embed(words, "topic"), key="job_title", entity_nodes=names.distinct(), topic_nodes=words,
        threshold=0.4)
    return edges.withColumn("cosine_similarity", round_half_up("cosine_similarity", 5))


@query("e7_post_links", f"""WITH
texts AS (SELECT 'post:' || conv_id || '-' || turn AS id, text || chr(10) || role AS t FROM conversations
          UNION SELECT DISTINCT 'word:' || w, w FROM (
            SELECT unnest(string_split_regex(lower(text), '\\s+')) AS w FROM benchmark) WHERE length(w) >= 8),
{embedded_sql('id', 'texts', 't', 384)},
pairs AS (
  SELECT substr(a.id, 6) AS src, substr(b.id, 6) AS dst, sum(a.x * b.x) AS sim FROM word_vectors a JOIN word_vectors b ON a.i = b.i
  WHERE a.id LIKE 'post:%' AND b.id LIKE 'word:%' GROUP BY a.id, b.id
)
SELECT src, dst, {rounded('sim', 5)} AS cosine_similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY {rounded('sim', 5)} DESC, dst) AS rank FROM pairs WHERE sim >= 0.35 QUALIFY rank <= 3)""")
def e7_post_links(spark, sf_dir):
    """Posts to topics end to end: body and tags become one text, its vector, and links of 0.35 and more."""
    posts = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("body"), F.col("role").alias("tags"))
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("topic"))
    words = words.where(F.length("topic") >= 8).distinct()
    edges = pipelines.link_pipeline(
        pipelines.post_vectors_pipeline(posts), embed(words, "topic"), key="id", entity_nodes=posts.select("id"), topic_nodes=words)
    return edges.withColumn("cosine_similarity", round_half_up("cosine_similarity", 5))
