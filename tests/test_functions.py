import datetime as dt

from pyspark.sql import functions as F

from topicloom.constants import PREDICATE_KINDS
from topicloom.functions import columns as c
from topicloom.functions import predicates as p
from topicloom.functions import text as t


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr("x").alias("y")).first()["y"]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], [" Author Keywords", "Open-Access "])
    assert c.normalize_column_names(df).columns == ["author_keywords", "open_access"]
    df = spark.createDataFrame([(1, 2, 3)], ["_Id", "_PostTypeId", "body"])
    assert c.snake_case_columns(df).columns == ["id", "post_type_id", "body"]


def test_to_long(spark):
    assert [one(spark, x, c.to_long) for x in ("12", "x", "", None, "1.0")] == [12, None, None, None, 1]
    assert one(spark, 7.0, c.to_long, "double") == 7


def test_author_fields(spark):
    assert one(spark, "Smith J., Univ X, City", c.author_of) == "Smith J."
    assert one(spark, "Smith J., Univ X, City", c.affiliation_of) == "Univ X, City"
    assert one(spark, ", x", c.author_of) == ""
    assert one(spark, "NoComma", c.affiliation_of) == ""
    assert one(spark, " a ;\tb;; ", lambda x: c.split_clean(x, ";")) == ["a", "b"]


def test_scalars(spark):
    assert one(spark, "<java><big data>", c.tags_to_csv) == "java,big data"
    assert one(spark, None, c.tags_to_csv) is None
    assert one(spark, "<http://x/topics/machine_learning>", c.topic_slug) == "machine_learning"
    assert one(spark, "<http://x/other>", c.topic_slug) == ""
    assert one(spark, 1.005, lambda x: c.round_half_up(x, 2), "double") == 1.01
    assert one(spark, 1, lambda x: c.pct(x, F.lit(0)), "long") is None
    assert one(spark, "\t a b \n", c.strip) == "a b"
    assert one(spark, [1, 2], lambda x: c.item_at(x, 5), "array<int>") is None
    assert one(spark, None, lambda x: c.join_text(x, F.lit("b"))) == "\nb"


def test_years_in_is_a_range(spark):
    days = [dt.datetime(2011, 12, 31, 23, 59), dt.datetime(2012, 1, 1), dt.datetime(2022, 6, 1), dt.datetime(2026, 1, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp")
    kept = df.where(p.years_in("ts", [2012, 2022, 2023, 2024, 2025])).collect()
    assert [r.ts.year for r in kept] == [2012, 2022]


def test_words_and_keywords(spark):
    df = spark.createDataFrame([("IT Services",), ("Fitness",), ("software dev",), (None,)], "n string")
    assert {r.n for r in df.where(p.has_word("n", ["IT", "SOFTWARE"])).collect()} == {"IT Services", "software dev"}
    df = spark.createDataFrame([("information_retrieval",), ("graphs",)], "n string")
    assert [r.n for r in p.drop_containing(df, "n", ["information", "system"]).collect()] == ["graphs"]


def test_not_equal_drops_null(spark):
    df = spark.createDataFrame([(None,), (2,), (4,)], "t int")
    assert [r.t for r in df.where(F.col("t") != 2).collect()] == [4]


def test_predicate_kind_first_hit_wins(spark):
    both = "#relatedEquivalent-superTopicOf"
    assert one(spark, both, p.predicate_kind) == PREDICATE_KINDS[0]
    assert one(spark, "#label", p.predicate_kind) is None


def test_titles(spark):
    cases = {
        "Senior Mid-Level  Engineer": "-level engineer", "Sr. Staff SWE": ". swe", "   ": "", "": "", None: "",
        "Leading Principal": "leading",
    }
    for title, want in cases.items():
        assert one(spark, title, t.normalize_title) == want
    assert one(spark, "Mid-Level Engineer", lambda x: t.normalize_title(x, strict=False)) == "engineer"


def test_html(spark):
    cases = {
        "<p>Use <code>x &lt; y</code>\n<a href='http://a.b/c'>This</a></p>": "use x y this",
        "see https://a.b/c?d=1 now": "see now",
        "<style>p{}</style><script>var a='<p>';</script>Hi<!-- no <b> -->": "hi",
        "<head><title>T</title></head><body><h2>Top</h2>a<br>b</body>": "## top a b",
        "a &amp;lt; b &#39;q&#x27; &#8364; &unknown; &copy; R&D": "a &lt; b q € &unknown; (c) r&d",
        "<script>var a=\"<!--\";</script><p>Body text stays</p>": "body text stays",
        "cut <a href=\"x": "cut", None: "", "": "",
    }
    for body, want in cases.items():
        assert one(spark, body, t.clean_html) == want, body


def test_html_lists(spark):
    cases = {
        "<ol><li>One</li><li>Two</li></ol>": "1. one 2. two",
        "<OL START='4'><LI>a<LI>b</OL>c": "4. a 5. b c",
        "<ol><li>a<ul><li>x</li><li>y</li></ul></li><li>b<ol><li>p</li></ol></li><li>c</li></ol>": "1. a x y 2. b 1. p 3. c",
        "<ul><li>x<ol start=\"10\"><li>t</li></ol></li><li>y</li></ul>": "x 10. t y",
        "<li>loose</li></ol><ol><li><p>par</p></li></ol>": "loose 1. par",
        "<ol start='x'><li>a</li></ol>": "1. a", "<ol start=-1><li>a<li>b<li>c</ol>": "-1. a 0. b 1. c",
        "<ol><!-- <li>no</li> --><li>yes</li><script>'<li>'</script></ol>": "1. yes",
        "&lt;ol&gt;&lt;li&gt;<ol><li>q": "olli 1. q",
    }
    bodies = spark.createDataFrame([(body,) for body in cases], "body string")
    assert {r.body: r.text for r in bodies.select("body", t.clean_html("body").alias("text")).collect()} == cases


def test_html_tables(spark):
    cases = {
        "<table><thead><tr><th>Name</th><th>Age</th></tr></thead><tbody><tr><td>Jo</td><td>7</td></tr></tbody></table>end":
            "name| age ---|--- jo| 7 end",
        "<table><tr><td>only</td></tr><tr><td>a</td><td></td><td>c</td></tr></table>": "only --- a| | c",
        "<table><tr><td>a</td></tr></table><table><tr><td>b</td><td>c</td></tr></table>": "a --- b| c ---|---",
        "<table><tr><td><ol><li>x</li><li>y</li></ol></td><td>z</td></tr></table>": "1. x 2. y | z ---|---",
        "<td>no row</td><td>second</td>": "no row| second",
    }
    bodies = spark.createDataFrame([(body,) for body in cases], "body string")
    assert {r.body: r.text for r in bodies.select("body", t.clean_html("body").alias("text")).collect()} == cases
    many = "<table>" + "<tr><td>a</td><td>b</td></tr>" * 50_000 + "</table>"
    assert one(spark, many, t.clean_html) == "a| b ---|---" + " a| b" * 49_999


def test_html_is_built_once_for_python(spark):
    bodies = spark.createDataFrame([("<h2>T</h2><ol><li>a</ol>&amp;",), ("<H6 x>a&lt;b<h7>c",)], "body string")
    df = bodies.select(t.clean_html("body").alias("text"))
    assert [r.text for r in df.collect()] == ["## t 1. a &", "###### abc"]
    udf = next(line for line in df._jdf.queryExecution().executedPlan().toString().split("\n+- ")[1:] if "_with_structure" in line)
    assert udf.count("<script") == 1


def test_keywords_and_ngrams(spark):
    assert one(spark, " Computer-Science  II", t.normalize_keyword) == "computer_science_ii"
    assert one(spark, "A b, c", lambda x: t.ngrams(t.tokens(x))) == ["a", "b", "c", "a_b", "b_c", "a_b_c"]
    assert one(spark, "a", lambda x: t.ngrams(t.tokens(x))) == ["a"]
    assert one(spark, "", lambda x: t.ngrams(t.tokens(x))) == []
