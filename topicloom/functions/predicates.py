"""Filters as columns, and filters on whole frames."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.constants import PREDICATE_KINDS


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.where(_all(F.col(c).isNotNull() for c in cols))


def years_in(ts: Column | str, years: Sequence[int]) -> Column:
    """Timestamp falls in one of the years, written as ranges so that the scan can skip row groups."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    spans: list[list[int]] = []
    for year in sorted(set(years)):
        if spans and spans[-1][1] == year:
            spans[-1][1] = year + 1
        else:
            spans.append([year, year + 1])
    return _any((ts >= F.lit(dt.date(a, 1, 1))) & (ts < F.lit(dt.date(b, 1, 1))) for a, b in spans)


def has_word(c: Column | str, words: Sequence[str]) -> Column:
    """One of the words occurs as a whole word, in any case."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"(?i)\b(" + "|".join(re.escape(w) for w in words) + r")\b")


def drop_containing(df: DataFrame, col: str, keywords: Sequence[str]) -> DataFrame:
    """Leave out rows whose text contains any keyword."""
    return df.where(~F.col(col).rlike("|".join(re.escape(k) for k in keywords)))


def non_empty(*cols: Column | str) -> Column:
    return _all((F.col(c) if isinstance(c, str) else c) != "" for c in cols)


def drop_self_edges(edges: DataFrame, a: str = "parent", b: str = "child") -> DataFrame:
    """No edge from a node to itself, every other edge once."""
    return edges.where(F.col(a) != F.col(b)).distinct()


def predicate_kind(c: Column | str) -> Column:
    """Which ontology relation an address stands for; null for any other."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.when(c.contains(kind), F.lit(kind)) for kind in PREDICATE_KINDS])


def maybe_year(df: DataFrame, col: str, year: int | None = None) -> DataFrame:
    """Keep one year, or everything when no year is asked for."""
    return df if year is None else df.where(F.col(col) == year)
