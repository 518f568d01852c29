"""Text cleaning, classification, matching and linking on the test tables."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import functions as F

from catalog.registry import on_graph, query, rounded
from topicloom.functions.columns import round_half_up, tags_to_csv
from topicloom.functions.text import (
    ASCII_ENTITIES, HTML_STEPS, TEXT_STEPS, clean_html, entity_texts, normalize_keyword, normalize_title, tokens,
)
from topicloom.operators.aggregates import joined_runs
from topicloom.operators.classify import classify_topics, vocabulary
from topicloom.operators.encode import embed
from topicloom.operators.fuzzy import fuzzy_match
from topicloom.operators.linking import link_topics
from topicloom.operators.people import author_affiliations, paper_authors
from topicloom.operators.topk import top_k_per_key
from topicloom.plans.proxy import table, text_table


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return expr


def decoded_sql(expr: str) -> str:
    """Entities of a text in SQL: split on ``&``, decode each piece, join again."""
    names = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in entity_texts().items()) + "}"
    numbers = "MAP {" + ", ".join(f"{name2codepoint[k]}: {quoted(v)}" for k, v in ASCII_ENTITIES.items()) + "}"
    return f"""
  (SELECT string_agg(CASE WHEN i = 1 THEN piece WHEN known IS NULL THEN '&' || piece
                          ELSE known || substr(piece, instr(piece, ';') + 1) END, '' ORDER BY i)
   FROM (SELECT i, piece, coalesce(
           {names}[regexp_extract(piece, '^([A-Za-z][A-Za-z0-9]*);', 1)],
           {numbers}[TRY_CAST(regexp_extract(piece, '^#([0-9]{{1,7}});', 1) AS INTEGER)],
           chr(TRY_CAST(regexp_extract(piece, '^#([0-9]{{1,7}});', 1) AS INTEGER))) AS known
         FROM (SELECT unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i
               FROM (SELECT string_split({expr}, '&') AS pieces))))"""


def clean_sql(column: str, tab: str, key: str) -> str:
    return f"""
SELECT {key}, lower(trim({replaced('plain', TEXT_STEPS)})) AS body
FROM (SELECT {key}, {decoded_sql('stripped')} AS plain
      FROM (SELECT {key}, {replaced(column, HTML_STEPS)} AS stripped FROM {tab}))"""


@query("n3_clean_html", clean_sql("html", "pages", "page_id"))
def n3_clean_html(spark, sf_dir):
    return text_table(spark, sf_dir, "pages").select("page_id", clean_html("html").alias("body"))


@query("n3_lists_and_tables", """
WITH lines AS (
  SELECT l_orderkey, l_linenumber AS n, l_partkey AS part, l_returnflag || l_linestatus AS flag, l_suppkey AS supp,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem)
SELECT l_orderkey, 'order ' || l_orderkey || ' ' ||
  string_agg((l_orderkey % 5 + place - 1) || '. part ' || part || ' of supplier ' || supp || ' 1. ' || lower(flag), ' ' ORDER BY place)
  || ' part| flag ---|--- ' || string_agg(part || '| ' || lower(flag), ' ' ORDER BY place) AS body
FROM lines GROUP BY l_orderkey""")
def n3_lists_and_tables(spark, sf_dir):
    """Every order as a numbered list with lists in it, and as a table; the SQL states the text and parses no HTML."""
    flag, part, supp = F.concat("l_returnflag", "l_linestatus"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    place = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag"]
    lines = table(spark, sf_dir, "lineitem").select(*place[:-1], flag.alias("flag")).repartition("l_orderkey").sortWithinPartitions(*place)
    item = F.concat(F.lit("<li>Part "), part, F.lit("<ul><li>of supplier <b>"), supp, F.lit("</b></li></ul><ol><li>"), "flag", F.lit("</li></ol></li>"))
    row = F.concat(F.lit("<tr><td>"), part, F.lit("</td><td>"), "flag", F.lit("</td></tr>"))
    key = lines.schema["l_orderkey"].dataType.simpleString()
    orders = lines.select("l_orderkey", item.alias("items"), row.alias("rows")).mapInArrow(
        joined_runs, f"l_orderkey {key}, items string, rows string")
    html = F.concat(
        F.lit("<p>Order "), F.col("l_orderkey").cast("string"), F.lit('</p><ol start="'), (F.col("l_orderkey") % 5).cast("string"), F.lit('">'),
        "items", F.lit("</ol><table><tr><th>Part</th><th>Flag</th></tr>"), "rows", F.lit("</table>"))
    return orders.select("l_orderkey", clean_html(html).alias("body"))


LEVELS = "CASE p_size % 5 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Jr' WHEN 2 THEN 'Lead' WHEN 3 THEN 'Staff' ELSE 'Mid-Level' END"


def _titles(part):
    level = F.element_at(F.array(*[F.lit(x) for x in ("Senior", "Jr", "Lead", "Staff", "Mid-Level")]), F.col("p_size") % 5 + 1)
    return F.concat_ws("  ", level, "p_name")


@query("n4_normalize_title", rf"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower({LEVELS} || '  ' || p_name),
  '\b(junior|jr|mid|middle|mid-level|senior|sr|lead|principal|staff)\b', '', 'g'), '\s+', ' ', 'g')) AS title FROM part""")
def n4_normalize_title(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", normalize_title(_titles(part)).alias("title"))


WORDS = r"""
doc_words AS (
  SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS word FROM documents
),
terms AS (
  SELECT DISTINCT word AS name FROM (
    SELECT unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS word FROM benchmark)
  WHERE length(word) >= 8
)"""


def benchmark_terms(spark, sf_dir):
    """The long words of ``benchmark`` as topic names."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens("text")).alias("name"))
    return words.where(F.length("name") >= 8).distinct()


# DuckDB counts edits in bytes, so the SQL first maps the accented letters of the data to single
# ASCII signs that no word contains.
ONE_BYTE = "translate({}, 'ßäçèéêíñóöü', '!#$%&()*+,-')"


@query("n5_fuzzy_match", f"""WITH {WORDS}
SELECT word AS keyword, name AS topic, CAST(levenshtein(a, b) AS INTEGER) AS distance
FROM (SELECT word, {ONE_BYTE.format('word')} AS a FROM doc_words)
JOIN (SELECT name, {ONE_BYTE.format('name')} AS b FROM terms)
  ON abs(length(a) - length(b)) <= 1 AND levenshtein(a, b) <= 1""")
def n5_fuzzy_match(spark, sf_dir):
    words = text_table(spark, sf_dir, "documents").select(F.explode(tokens("text")).alias("keyword"))
    return fuzzy_match(words, benchmark_terms(spark, sf_dir), max_dist=1)


@query("n5_normalize_keyword", r"""
SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(p_name || ' / ' || p_type), '[^\p{L}\p{N}]+'), lambda w: w <> ''), '_') AS keyword
FROM part""")
def n5_normalize_keyword(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", normalize_keyword(F.concat_ws(" / ", "p_name", "p_type")).alias("keyword"))


CENTROIDS = """
places AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
),
centroids AS (
  SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM places GROUP BY label, i) GROUP BY label
)"""


def _centroids(spark, sf_dir):
    """The mean vector of each label, as topics."""
    places = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = places.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "m")))
    return means.groupBy("label").agg(F.transform(ordered, lambda p: p["m"]).alias("embedding")).select(
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("topic"), "embedding")


def _links(df):
    return df.withColumns({"cosine_similarity": round_half_up("cosine_similarity", 6), "rank": F.col("rank").cast("long")})


@query("n6_link_to_centroids", f"""WITH {CENTROIDS}
SELECT vec_id, topic, {rounded('sim', 6)} AS cosine_similarity, rank FROM (
  SELECT vec_id, topic, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) AS rank FROM (
    SELECT vec_id, 'label_' || c.label AS topic, list_cosine_similarity(embedding::DOUBLE[], c) AS sim FROM embeddings, centroids c)
  WHERE sim >= 0.1 QUALIFY rank <= 3)""")
def n6_link_to_centroids(spark, sf_dir):
    return _links(link_topics(table(spark, sf_dir, "embeddings"), _centroids(spark, sf_dir), key="vec_id", threshold=0.1, dim=64))


@query("n6_cosine_top3", f"""
SELECT vec_id, topic, {rounded('sim', 6)} AS cosine_similarity, rank FROM (
  SELECT vec_id, topic, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) AS rank FROM (
    SELECT a.vec_id, 'vec_' || b.vec_id AS topic, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
    FROM embeddings a, embeddings b)
  WHERE sim >= 0.35 QUALIFY rank <= 3)""")
def n6_cosine_top3(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    topics = vectors.select(F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("topic"), "embedding")
    return _links(link_topics(vectors, topics, key="vec_id", dim=64))


@query("n6_repeated_topics", f"""
SELECT vec_id, topic, {rounded('sim', 6)} AS cosine_similarity, rank FROM (
  SELECT vec_id, topic, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) AS rank FROM (
    SELECT a.vec_id, 'label_' || b.label AS topic, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS sim
    FROM embeddings a, embeddings b GROUP BY a.vec_id, b.label)
  WHERE sim >= 0.1 QUALIFY rank <= 3)""")
def n6_repeated_topics(spark, sf_dir):
    """Topics with many vectors each: every vector of a label is one more vector of that topic."""
    vectors = table(spark, sf_dir, "embeddings")
    topics = vectors.select(F.concat(F.lit("label_"), F.col("label").cast("string")).alias("topic"), "embedding")
    return _links(link_topics(vectors, topics, key="vec_id", threshold=0.1, dim=64))


SENTENCES = r"""
entries AS (
  SELECT doc_id, regexp_replace(part, '^\s+|\s+$', '', 'g') AS entry
  FROM (SELECT doc_id, unnest(string_split(text, '.')) AS part FROM documents)
)"""


@query("n7_author_affiliations", rf"""WITH {SENTENCES}
SELECT DISTINCT regexp_extract(entry, '^([^,]+)', 1) AS author, regexp_extract(entry, '^[^,]+,\s*(.*)', 1) AS affiliation
FROM entries WHERE regexp_extract(entry, '^([^,]+)', 1) <> '' AND regexp_extract(entry, '^[^,]+,\s*(.*)', 1) <> ''""")
def n7_author_affiliations(spark, sf_dir):
    return author_affiliations(text_table(spark, sf_dir, "documents"), col="text", sep=".")


@query("n7_paper_authors", f"WITH {SENTENCES} SELECT DISTINCT entry AS author, doc_id FROM entries WHERE entry <> ''")
def n7_paper_authors(spark, sf_dir):
    return paper_authors(text_table(spark, sf_dir, "documents"), key="doc_id", col="text", sep=".")


TERM_TREE = "term_tree AS (SELECT name AS src, 'starts_' || substr(name, 1, 2) AS dst FROM terms)"

CLASSIFIED = r"""
grams AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]),
                        list_transform(range(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2]))) AS phrase
  FROM (SELECT doc_id, list_filter(string_split_regex(lower(source || chr(10) || text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM documents)
),
hits AS (
  SELECT doc_id, name AS topic, 1 AS direct FROM grams JOIN terms ON name = phrase
  UNION ALL SELECT doc_id, dst, 0 FROM grams JOIN term_tree ON src = phrase
),
scores AS (SELECT doc_id, topic, count(*) AS score, max(direct) AS direct FROM hits GROUP BY doc_id, topic)"""


def term_tree(terms):
    """Each term below a topic named by its first two letters."""
    return terms.select(F.col("name").alias("src"), F.concat(F.lit("starts_"), F.substring("name", 1, 2)).alias("dst"))


def classified(spark, sf_dir, **options):
    terms = benchmark_terms(spark, sf_dir)
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return classify_topics(docs, vocabulary(terms), term_tree(terms), key="doc_id", text_cols=("source", "text"), **options)


@query("n1_classify_topics", f"""WITH {WORDS}, {TERM_TREE}, {CLASSIFIED}
SELECT doc_id, topic, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS rank FROM scores QUALIFY rank <= 5""")
def n1_classify_topics(spark, sf_dir):
    return classified(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


@query("n1_classify_inferred", f"WITH {WORDS}, {TERM_TREE}, {CLASSIFIED} SELECT doc_id, topic, score FROM scores WHERE direct = 0")
def n1_classify_inferred(spark, sf_dir):
    return classified(spark, sf_dir, k=None, include_direct=False)


@query("n1_classify_near", f"""WITH {WORDS}, {TERM_TREE},
spelt AS (
  SELECT name AS phrase, name AS topic FROM terms
  UNION SELECT word, name FROM (
    SELECT word, {ONE_BYTE.format('word')} AS a FROM (
      SELECT word FROM doc_words UNION SELECT unnest(string_split_regex(lower(source), '[^\\p{{L}}\\p{{N}}]+')) FROM documents)
    WHERE word NOT IN (SELECT name FROM terms))
  JOIN (SELECT name, {ONE_BYTE.format('name')} AS b FROM terms)
    ON abs(length(a) - length(b)) <= 1 AND levenshtein(a, b) <= 1
),
{CLASSIFIED.replace("grams JOIN terms ON name = phrase", "grams JOIN spelt USING (phrase)").replace("name AS topic, 1 AS direct", "topic, 1 AS direct")
           .replace("grams JOIN term_tree ON src = phrase", "grams JOIN spelt USING (phrase) JOIN term_tree ON src = topic")}
SELECT doc_id, topic, score FROM scores""")
def n1_classify_near(spark, sf_dir):
    """Topics found by their names and by spellings one edit off."""
    return classified(spark, sf_dir, k=None, near=1).select("doc_id", "topic", "score")


def embedded_sql(key: str, tab: str, column: str, dim: int) -> str:
    """Signed word hashing in SQL: ``key, i, x`` for every place that is not zero."""
    return f"""
word_hashes AS (
  SELECT {key}, md5(word) AS h FROM (
    SELECT {key}, unnest(string_split_regex(lower({column}), '\\s+')) AS word FROM {tab}) WHERE word <> ''
),
word_places AS (
  SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % {dim} AS i,
         CASE WHEN ('0x' || substr(h, 9, 1))::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS sign FROM word_hashes
),
word_sums AS (SELECT {key}, i, sum(sign)::DOUBLE AS x FROM word_places GROUP BY {key}, i),
word_vectors AS (
  SELECT s.{key}, i, (x / norm)::FLOAT::DOUBLE AS x FROM word_sums s
  JOIN (SELECT {key}, sqrt(sum(x * x)) AS norm FROM word_sums GROUP BY {key}) n ON n.{key} = s.{key} WHERE x <> 0
)"""


@query("n2_embed", f"WITH {embedded_sql('conv_turn', '(SELECT conv_id * 1000 + turn AS conv_turn, text FROM conversations)', 'text', 64)} "
                   f"SELECT conv_turn, i, {rounded('x', 5)} AS x FROM word_vectors")
def n2_embed(spark, sf_dir):
    turns = text_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("conv_turn"), "text")
    places = embed(turns, "text", dim=64).select("conv_turn", F.posexplode("embedding").alias("i", "x"))
    return places.where(F.col("x") != 0).select(
        "conv_turn", F.col("i").cast("long").alias("i"), round_half_up(F.col("x").cast("double"), 5).alias("x"))
