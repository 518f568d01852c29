"""The eight questions on the proxy graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import on_graph, query, rounded
from topicloom.functions.columns import round_half_up
from topicloom.plans import questions as q
from topicloom.plans.proxy import PROXY_YEARS, proxy_graph

USAGE = """
usage AS (
  SELECT t.name AS topic, coalesce(p.n, 0) AS paper_count, coalesce(j.n, 0) AS job_count, coalesce(s.n, 0) AS so_count,
         100.0 * coalesce(p.n, 0) / (SELECT count(*) FROM paper)::DOUBLE AS paper_share,
         100.0 * coalesce(j.n, 0) / (SELECT count(*) FROM jobrole)::DOUBLE AS job_share,
         100.0 * coalesce(s.n, 0) / (SELECT count(*) FROM post)::DOUBLE AS so_share
  FROM topic t
  LEFT JOIN (SELECT dst, count(*) AS n FROM addresses GROUP BY dst) p ON p.dst = t.name
  LEFT JOIN (SELECT dst, count(*) AS n FROM requires GROUP BY dst) j ON j.dst = t.name
  LEFT JOIN (SELECT dst, count(*) AS n FROM tagged GROUP BY dst) s ON s.dst = t.name
)"""
USAGE_SELECT = f"""
SELECT topic, paper_count, job_count, so_count,
       {rounded('paper_share', 2)} AS paper_pct, {rounded('job_share', 2)} AS job_pct, {rounded('so_share', 2)} AS so_pct,
       {rounded('(paper_share + job_share + so_share) / 3.0', 2)} AS avg_pct
FROM usage"""


@query("q1_topic_usage", on_graph(f"SELECT * FROM ({USAGE_SELECT}) ORDER BY avg_pct DESC, topic LIMIT 10", USAGE))
def q1_topic_usage(spark, sf_dir):
    return q.q1_topic_usage(proxy_graph(spark, sf_dir))


@query("q1_topic_usage_all", on_graph(USAGE_SELECT, USAGE))
def q1_topic_usage_all(spark, sf_dir):
    return q.q1_topic_usage(proxy_graph(spark, sf_dir), n=None)


def _only_sql(keep: str, a: str, b: str, limit: str) -> str:
    return on_graph(f"""
SELECT dst AS topic FROM (SELECT dst, count(*) AS n FROM {keep} GROUP BY dst)
WHERE dst IN (SELECT name FROM topic) AND dst NOT IN (SELECT dst FROM {a}) AND dst NOT IN (SELECT dst FROM {b})
ORDER BY n DESC, dst {limit}""")


@query("q2_only_papers", _only_sql("addresses", "requires", "tagged", "LIMIT 10"))
def q2_only_papers(spark, sf_dir):
    return q.q2_single_domain(proxy_graph(spark, sf_dir))


@query("q2_only_papers_all", _only_sql("addresses", "requires", "tagged", ""))
def q2_only_papers_all(spark, sf_dir):
    return q.q2_single_domain(proxy_graph(spark, sf_dir), n=None)


@query("q2_only_posts", _only_sql("tagged", "requires", "addresses", ""))
def q2_only_posts(spark, sf_dir):
    return q.q2_single_domain(proxy_graph(spark, sf_dir), domain="StackOverflowPost", n=None)


ALL_THREE = """
SELECT name AS topic FROM topic WHERE name IN (SELECT dst FROM addresses)
AND name IN (SELECT dst FROM requires) AND name IN (SELECT dst FROM tagged)"""


@query("q3_all_domains", on_graph(ALL_THREE + " ORDER BY topic LIMIT 5"))
def q3_all_domains(spark, sf_dir):
    return q.q3_all_domains(proxy_graph(spark, sf_dir))


@query("q3_all_domains_all", on_graph(ALL_THREE))
def q3_all_domains_all(spark, sf_dir):
    return q.q3_all_domains(proxy_graph(spark, sf_dir), n=None)


def _yearly_sql(per_parent: bool) -> str:
    parent = (
        "JOIN subtopic_of s ON s.src = a.dst" if per_parent else "WHERE a.dst IN (SELECT src FROM subtopic_of)"
    )
    return f"""
yearly AS (
  SELECT a.dst AS topic, p.year, count(*) AS n
  FROM addresses a JOIN (SELECT * FROM paper WHERE year IN (1995, 1999, 2000, 2001)) p ON p.eid = a.src {parent}
  GROUP BY a.dst, p.year
),
trends AS (
  SELECT topic, CAST(sum(n) AS BIGINT) AS total,
         string_agg(year || ':' || n, ',' ORDER BY year) AS yearly_counts,
         CAST(coalesce(sum(n) FILTER (WHERE year = 1995), 0) AS BIGINT) AS count_start,
         CAST(coalesce(sum(n) FILTER (WHERE year = 2001), 0) AS BIGINT) AS count_end
  FROM yearly GROUP BY topic
)"""


TRENDS = "SELECT topic, total, yearly_counts, count_start, count_end, count_end - count_start AS growth FROM trends"


def _flat_series(df):
    text = F.transform("yearly_counts", lambda y: F.concat(y["year"].cast("string"), F.lit(":"), y["count"].cast("string")))
    return df.withColumn("yearly_counts", F.array_join(text, ","))


@query("q4_trends", on_graph(TRENDS + " ORDER BY growth DESC, topic LIMIT 10", _yearly_sql(True)))
def q4_trends(spark, sf_dir):
    return _flat_series(q.q4_trends(proxy_graph(spark, sf_dir), PROXY_YEARS))


@query("q4_trends_once_per_paper", on_graph(TRENDS, _yearly_sql(False)))
def q4_trends_once(spark, sf_dir):
    return _flat_series(q.q4_trends(proxy_graph(spark, sf_dir), PROXY_YEARS, n=None, per_parent=False))


@query("q5_growth_match", on_graph("""
SELECT * FROM (
  SELECT topic, (SELECT count(DISTINCT src) FROM requires WHERE dst = topic) AS job_count,
         (SELECT count(DISTINCT src) FROM tagged WHERE dst = topic) AS so_count
  FROM (SELECT topic FROM trends ORDER BY count_end - count_start DESC, topic LIMIT 100))
WHERE job_count > 0 AND so_count > 0""", _yearly_sql(True)))
def q5_growth_match(spark, sf_dir):
    return q.q5_growth_match(proxy_graph(spark, sf_dir), PROXY_YEARS, n=100)


JACCARD = """
sizes AS (SELECT src, count(*) AS n FROM addresses GROUP BY src),
common AS (
  SELECT a.src AS node, b.src AS neighbour, count(*) AS n
  FROM addresses a JOIN addresses b ON a.dst = b.dst AND a.src <> b.src GROUP BY a.src, b.src
),
jaccard AS (
  SELECT node, neighbour, c.n::DOUBLE / (x.n + y.n - c.n) AS similarity
  FROM common c JOIN sizes x ON x.src = node JOIN sizes y ON y.src = neighbour
)"""


def nearest(cutoff: float, k: int) -> str:
    return f"""
nearest AS (
  SELECT node, neighbour, similarity,
         row_number() OVER (PARTITION BY node ORDER BY similarity DESC, neighbour) AS rank
  FROM jaccard WHERE similarity > {cutoff} QUALIFY rank <= {k}
)"""


def _q6_sql(limit: str) -> str:
    return on_graph(f"""
SELECT p.eid AS paper_eid, p.title AS paper_title,
       string_agg(o.title || '=' || printf('%.3f', {rounded('similarity', 3)}), ', ' ORDER BY rank) AS top_similar
FROM nearest JOIN paper p ON p.eid = node JOIN paper o ON o.eid = neighbour
GROUP BY p.eid, p.title ORDER BY paper_eid {limit}""", JACCARD, nearest(0.3, 3))


def _flat_similar(df):
    text = F.transform("top_similar", lambda s: F.concat(s["title"], F.lit("="), F.format_string("%.3f", s["sim"])))
    return df.withColumn("top_similar", F.array_join(text, ", "))


@query("q6_similar_papers", _q6_sql("LIMIT 3"))
def q6_similar_papers(spark, sf_dir):
    return _flat_similar(q.q6_similar_papers(proxy_graph(spark, sf_dir)))


@query("q6_similar_papers_all", _q6_sql(""))
def q6_similar_papers_all(spark, sf_dir):
    return _flat_similar(q.q6_similar_papers(proxy_graph(spark, sf_dir), n=None))


def _q7_sql(limit: str) -> str:
    return on_graph(f"""
SELECT node AS paper, neighbour, p.title AS paper_title, o.title AS similar_paper_title,
       x.names AS paper_authors, y.names AS similar_paper_authors, {rounded('similarity', 3)} AS sim_score
FROM nearest JOIN paper p ON p.eid = node JOIN paper o ON o.eid = neighbour
JOIN names x ON x.dst = node JOIN names y ON y.dst = neighbour
ORDER BY node, rank {limit}""", JACCARD, nearest(0.8, 3), """
names AS (SELECT dst, string_agg(src, '; ' ORDER BY src) AS names FROM authored GROUP BY dst)""")


def _flat_authors(df):
    return df.withColumns({c: F.array_join(c, "; ") for c in ("paper_authors", "similar_paper_authors")})


@query("q7_similar_authors", _q7_sql("LIMIT 3"))
def q7_similar_authors(spark, sf_dir):
    return _flat_authors(q.q7_similar_authors(proxy_graph(spark, sf_dir)))


@query("q7_similar_authors_all", _q7_sql(""))
def q7_similar_authors_all(spark, sf_dir):
    return _flat_authors(q.q7_similar_authors(proxy_graph(spark, sf_dir), n=None))


FULL_GRAPH = """
both_ways AS (
  SELECT 'Paper:' || src AS a, 'Topic:' || dst AS b FROM addresses
  UNION ALL SELECT 'JobRole:' || src, 'Topic:' || dst FROM requires
  UNION ALL SELECT 'StackOverflowPost:' || src, 'Topic:' || dst FROM tagged WHERE src IN (SELECT id FROM post)
  UNION ALL SELECT 'Author:' || src, 'Paper:' || dst FROM authored
  UNION ALL SELECT 'Company:' || src, 'Job:' || dst FROM posted
  UNION ALL SELECT 'Job:' || src, 'JobRole:' || dst FROM has_role
),
full_edges AS (SELECT DISTINCT a AS src, b AS dst FROM both_ways UNION SELECT DISTINCT b, a FROM both_ways),
full_nodes AS (
  SELECT 'Topic' AS label, name AS key FROM topic
  UNION ALL SELECT 'Paper', eid::VARCHAR FROM paper
  UNION ALL SELECT 'JobRole', name::VARCHAR FROM jobrole
  UNION ALL SELECT 'StackOverflowPost', id::VARCHAR FROM post
  UNION ALL SELECT 'Author', author FROM author
  UNION ALL SELECT 'Company', company_id FROM company
  UNION ALL SELECT 'Job', job_id::VARCHAR FROM job
),
full_degree AS (
  SELECT label, key, label || ':' || key AS id, coalesce(n, 0) AS degree
  FROM full_nodes LEFT JOIN (SELECT src, count(*) AS n FROM full_edges GROUP BY src) d ON d.src = label || ':' || key
)"""


def rank_rounds(nodes: str, edges: str, rounds: int = 20) -> str:
    """PageRank unrolled: ``nodes(id)``, ``edges(src, dst)`` to ``rank_<rounds>(id, r)``."""
    head = f"""
rank_out AS MATERIALIZED (SELECT src, count(*) AS n FROM {edges} GROUP BY src),
rank_share AS MATERIALIZED (SELECT e.src, e.dst, 1.0 / o.n AS share FROM {edges} e JOIN rank_out o ON o.src = e.src),
rank_size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM {nodes}),
rank_0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT n FROM rank_size) AS r FROM {nodes})"""
    steps = [f"""
rank_{i} AS MATERIALIZED (
  SELECT v.id, 0.15 / (SELECT n FROM rank_size) + 0.85 * (
    (SELECT coalesce(sum(r), 0.0) FROM rank_{i - 1} WHERE id NOT IN (SELECT src FROM rank_out)) / (SELECT n FROM rank_size)
    + coalesce(x.s, 0.0)) AS r
  FROM {nodes} v LEFT JOIN (
    SELECT e.dst, sum(p.r * e.share) AS s FROM rank_{i - 1} p JOIN rank_share e ON e.src = p.id GROUP BY e.dst
  ) x ON x.dst = v.id)""" for i in range(1, rounds + 1)]
    return ",".join([head, *steps])


@query("q8_hubs", on_graph(f"""
SELECT label, key, degree, {rounded('r * 1000', 6)} AS pagerank,
       row_number() OVER (PARTITION BY label ORDER BY degree DESC, key) AS rank
FROM full_degree JOIN rank_20 USING (id) QUALIFY rank <= 10""", FULL_GRAPH, rank_rounds("full_degree", "full_edges")))
def q8_hubs(spark, sf_dir):
    top = q.q8_hubs(proxy_graph(spark, sf_dir))
    return top.withColumns({
        "pagerank": round_half_up(F.col("pagerank") * 1000, 6), "rank": F.col("rank").cast("long")
    })
