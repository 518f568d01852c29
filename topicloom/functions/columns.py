"""Column names and scalar columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.constants import AFFILIATION_PATTERN, AUTHOR_PATTERN, TOPIC_URI_PATTERN


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_column_names(df: DataFrame) -> DataFrame:
    """``" Author-Keywords "`` becomes ``author_keywords``."""
    return df.toDF(*[re.sub(r"[ -]", "_", name.strip().lower()) for name in df.columns])


def snake_case_columns(df: DataFrame) -> DataFrame:
    """``_PostTypeId`` becomes ``post_type_id``."""
    return df.toDF(*[re.sub(r"\B([A-Z])", r"_\1", name.lstrip("_")).lower() for name in df.columns])


def to_long(c: Column | str) -> Column:
    """Cast to long; text that is no number gives null instead of an error.

    Decimal text loses its fraction: ``"2774458.0"`` is 2774458.
    """
    value = _col(c)
    return F.coalesce(
        value.try_cast("long"),
        F.when(value.cast("string").rlike(r"^\s*[+-]?\d+\.\d*\s*$"), F.trim(value.cast("string")).try_cast("decimal(38,6)").try_cast("long")),
    )


def strip(c: Column | str) -> Column:
    """Trim blanks, tabs and line ends on both sides (``trim`` knows blanks only)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def join_text(*cols: Column | str, sep: str = "\n") -> Column:
    """Concatenate text columns, a null counting as empty text."""
    return F.concat_ws(sep, *[blank_if_null(c) for c in cols])


def split_clean(c: Column | str, delimiter: str) -> Column:
    """Split on a literal delimiter, trim the parts, drop the empty ones."""
    parts = F.split(_col(c), re.escape(delimiter))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def author_of(c: Column | str) -> Column:
    """The text before the first comma."""
    return F.regexp_extract(_col(c), AUTHOR_PATTERN, 1)


def affiliation_of(c: Column | str) -> Column:
    """The text after the first comma."""
    return F.regexp_extract(_col(c), AFFILIATION_PATTERN, 1)


def topic_slug(c: Column | str) -> Column:
    """The topic name inside a topic address; empty if there is none."""
    return F.regexp_extract(_col(c), TOPIC_URI_PATTERN, 1)


def tags_to_csv(c: Column | str) -> Column:
    """``<a><b>`` becomes ``a,b``."""
    return F.replace(F.regexp_replace(_col(c), "^<|>$", ""), F.lit("><"), F.lit(","))


def round_half_up(c: Column | str, digits: int) -> Column:
    """Round through decimal, so that ties do not depend on the binary form."""
    return F.round(_col(c).cast("decimal(38,8)"), digits).cast("double")


def pct(n: Column | str, total: Column | str) -> Column:
    """Share in percent; null when the total is zero."""
    return F.try_divide(F.lit(100.0) * _col(n), _col(total).cast("double"))


def first_items(c: Column | str, n: int) -> Column:
    return F.slice(_col(c), 1, n)


def item_at(c: Column | str, index: int) -> Column:
    """Element by index from zero; null outside of the array."""
    return F.get(_col(c), index)


def joined(c: Column | str, sep: str = ", ") -> Column:
    return F.array_join(_col(c), sep)


def array_sum_where(c: Column | str, predicate, field: str) -> Column:
    """Sum ``field`` over the structs of an array that meet ``predicate``."""
    return F.aggregate(
        F.filter(_col(c), predicate), F.lit(0).cast("long"), lambda total, item: total + item[field].cast("long")
    )
