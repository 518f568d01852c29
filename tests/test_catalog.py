"""A sample of the named queries against their SQL on the smallest tables; check.py runs them all."""

import duckdb
import pytest

from check import TABLES, rows_of
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = [
    "q1_topic_usage", "q2_only_papers_all", "q4_trends", "q5_growth_match", "q6_similar_papers_all", "n3_clean_html",
    "n6_cosine_top3", "g1_canonical_hierarchy", "e2_jobs", "s7_triples", "k4_hierarchy_json", "s6_kept_bad_rows",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    want = con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    assert len(entry(spark).collect()) == 10


def test_all_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
