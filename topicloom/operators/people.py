"""Authors and affiliations out of delimited author fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.columns import affiliation_of, author_of, split_clean
from topicloom.functions.predicates import non_empty


def paper_authors(papers: DataFrame, key: str = "eid", col: str = "authors", sep: str = ";") -> DataFrame:
    """Distinct (author, paper key) pairs."""
    return papers.select(F.explode(split_clean(col, sep)).alias("author"), key).distinct()


def author_affiliations(papers: DataFrame, col: str = "authors_with_affiliations", sep: str = ";") -> DataFrame:
    """Distinct (author, affiliation) pairs; entries lacking either part are left out."""
    entries = papers.select(F.explode(split_clean(col, sep)).alias("entry"))
    return (
        entries.select(author_of("entry").alias("author"), affiliation_of("entry").alias("affiliation"))
        .where(non_empty("author", "affiliation"))
        .distinct()
    )
