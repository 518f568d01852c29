"""Fuzzy matching of keywords to topic names by edit distance.

Of two texts at most ``d`` edits apart, cut the shorter into ``d + 1`` segments: an edit touches one segment, so one is
left whole and stands in the longer text, moved by no more than the edits before it. So the texts of one side are
entered by their segments, and those of the other by the substrings that may be such a segment. A text has some
``(d + 1) ** 2`` times ``d`` substrings for every length its partner may have, whatever its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _segment(size: Column, i: Column, max_dist: int) -> tuple[Column, Column]:
    """Start, from 0, and length of segment ``i`` of a text of ``size`` characters cut into ``max_dist`` + 1."""
    short = F.floor(size / (max_dist + 1)).cast("int")
    long = size - short * (max_dist + 1)  # so many segments at the end are longer by one
    before = F.greatest(i - (max_dist + 1 - long), F.lit(0))
    return i * short + before, short + F.when(i >= max_dist + 1 - long, 1).otherwise(0)


def segments(c: Column, max_dist: int) -> Column:
    """The segments of a text with their number and the size of the text: ``array<struct<size, i, part>>``."""
    size = F.length(c)

    def one(i: Column) -> Column:
        start, length = _segment(size, i, max_dist)
        return F.struct(size.alias("size"), i.alias("i"), F.substring(c, start + 1, length).alias("part"))

    return F.transform(F.sequence(F.lit(0), F.lit(max_dist)), one)


def windows(c: Column, max_dist: int) -> Column:
    """All places of a text where a segment of a text of at most ``max_dist`` edits away may stand, in the same form."""
    own = F.length(c)

    def of_size(size: Column) -> Column:
        def of_segment(i: Column) -> Column:
            start, length = _segment(size, i, max_dist)
            # Before the first whole segment there are i edits at most if it is segment i, and max_dist - i after it.
            longer = own - size
            low = F.greatest(F.lit(0), start - i, start + longer - (max_dist - i))
            high = F.least(own - length, start + i, start + longer + (max_dist - i))
            places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: F.struct(size.alias("size"), i.alias("i"), F.substring(c, at + 1, length).alias("part")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(max_dist)), of_segment))

    sizes = F.sequence(F.greatest(own - max_dist, F.lit(0)), own + max_dist)
    return F.array_distinct(F.flatten(F.transform(sizes, of_size)))


def fuzzy_match(left: DataFrame, topics: DataFrame, max_dist: int = 1, col: str = "keyword", name: str = "name") -> DataFrame:
    """Distinct keywords and topic names at most ``max_dist`` edits apart, with the distance.

    Topic names are entered by their segments, keywords by the windows that may hold one; an equi-join on size, number
    and text of the segment finds every match, and the distance is then checked. Texts are made distinct first, which
    removes the weight of frequent words. Null texts match nothing, empty ones match texts of up to ``max_dist``
    characters.
    """
    def entered(df: DataFrame, c: str, alias: str, entries) -> DataFrame:
        words = df.select(F.col(c).alias(alias)).where(F.col(c).isNotNull()).distinct()
        return words.withColumn("entry", F.explode(entries(F.col(alias), max_dist))).select(alias, "entry.*")

    candidates = entered(left, col, "keyword", windows).join(entered(topics, name, "topic", segments), ["size", "i", "part"])
    return (
        candidates.select("keyword", "topic").distinct()
        .withColumn("distance", F.levenshtein("keyword", "topic", max_dist))
        .where(F.col("distance") >= 0)
    )
