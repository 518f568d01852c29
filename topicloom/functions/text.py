"""Text cleaning as column expressions: HTML bodies, job titles, keywords, n-grams."""

from __future__ import annotations

import re
from functools import lru_cache
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from topicloom.constants import LEVEL_WORDS, STRANGE_CHARS_PATTERN, URL_PATTERN
from topicloom.functions.columns import blank_if_null, strip

# Entities that are written in plain ASCII instead of their character.
ASCII_ENTITIES = {
    "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"', "copy": "(C)", "mdash": "--", "nbsp": " ",
    "rarr": "->", "larr": "<-", "middot": "*", "ndash": "-", "oelig": "oe", "aelig": "ae",
    "agrave": "a", "aacute": "a", "acirc": "a", "atilde": "a", "auml": "a", "aring": "a",
    "egrave": "e", "eacute": "e", "ecirc": "e", "euml": "e", "igrave": "i", "iacute": "i", "icirc": "i",
    "iuml": "i", "ograve": "o", "oacute": "o", "ocirc": "o", "otilde": "o", "ouml": "o",
    "ugrave": "u", "uacute": "u", "ucirc": "u", "uuml": "u",
}

# Tags that end a line of text.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p",
    "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)

# Applied in this order to raw HTML. The content of script and style goes first, as a comment
# mark in it opens no comment, then comments and the head. Headings keep a mark per level, block tags break the line, other tags vanish.
HTML_STEPS: list[tuple[str, str]] = [
    (r"(?is)<script\b.*?(</script\s*>|\z)", ""),
    (r"(?is)<style\b.*?(</style\s*>|\z)", ""),
    (r"(?s)<!--.*?(-->|\z)", ""),
    (r"(?is)<head\b.*?(</head\s*>|<body\b[^>]*>|\z)", "\n"),
    *[(rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ") for level in range(1, 7)],
    (r"(?i)</?(" + "|".join(BLOCK_TAGS) + r")\b[^>]*>", "\n"),
    (r"<[a-zA-Z/!?][^>]*(>|\z)", ""),
]

# Steps of HTML_STEPS that come before lists and tables are marked, and those of headings, which come right after.
HIDDEN_STEPS = 4
HEADING_STEPS = 6

STRUCTURE_TAG = re.compile(r"(<(?:/?)(?:ol|ul|li|table|tr|td|th)\b(?:[^>]*)(?:>|\Z))", re.IGNORECASE)
TAG_NAME = re.compile(r"</?[^\W\d_]+")
START_NUMBER = re.compile(r"""\bstart\s*=\s*["']?\s*(-?[0-9]{1,9})""", re.IGNORECASE)

# Applied in this order to the plain text.
TEXT_STEPS: list[tuple[str, str]] = [
    (URL_PATTERN, ""),
    (STRANGE_CHARS_PATTERN, ""),
    (r"\s+", " "),
]


def entity_texts() -> dict[str, str]:
    """Named entities and the text each stands for."""
    return {**{name: chr(code) for name, code in name2codepoint.items()}, **ASCII_ENTITIES}


def _numeric_texts() -> dict[int, str]:
    return {name2codepoint[name]: text for name, text in ASCII_ENTITIES.items()}


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decode_entities(c: Column) -> Column:
    """Replace named and numeric entities, each exactly once."""
    names = F.create_map(*[F.lit(x) for pair in entity_texts().items() for x in pair])
    numbers = F.create_map(*[F.lit(x) for pair in _numeric_texts().items() for x in pair])

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        decimal = F.regexp_extract(piece, r"^#([0-9]{1,7});", 1)
        hexa = F.regexp_extract(piece, r"^#[xX]([0-9A-Fa-f]{1,6});", 1)
        code = F.coalesce(decimal.try_cast("int"), F.conv(F.nullif(hexa, F.lit("")), 16, 10).try_cast("int"))
        numeric = _once(code, lambda n: F.coalesce(
            F.try_element_at(numbers, n), F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), _char(n))
        ))
        known = F.when(piece.startswith("#"), numeric).otherwise(F.try_element_at(names, name))
        tail = F.substr(piece, F.instr(piece, ";") + 1)
        return F.coalesce(F.concat(known, tail), F.concat(F.lit("&"), piece))

    def rejoined(pieces: Column) -> Column:
        return F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), decoded), ""))

    return _once(F.split(c, "&"), rejoined)


@lru_cache(maxsize=4096)
def _known_tag(tag: str) -> tuple[str, int | None]:
    """Name of a tag, with its slash, and the number before the first item of an ordered list."""
    # Letters that the pattern takes for one another.
    name = TAG_NAME.match(tag)[0][1:].lower().replace("\u0131", "i")
    first = START_NUMBER.search(tag) if name == "ol" else None
    return name, int(first[1]) - 1 if first else 0 if name == "ol" else None


def _structured(text: str) -> str:
    """Lists and tables of one text, read tag by tag.

    ``lists`` is the stack of open lists, each the number of its last item or None where items are not numbered.
    ``cells`` and ``below_head`` belong to the table row that was opened last: tables within cells share them.
    """
    pieces = STRUCTURE_TAG.split(text)
    lists: list[int | None] = []
    cells, below_head = 0, False
    for i in range(1, len(pieces), 2):
        tag = pieces[i]
        name, first = _known_tag(tag) if len(tag) <= 64 else _known_tag.__wrapped__(tag)
        out = "\n"
        if name == "/td" or name == "/th":
            out = ""
        elif name == "td" or name == "th":
            cells += 1
            out = "| " if cells > 1 else ""
        elif name == "li":
            if lists and lists[-1] is not None:
                lists[-1] += 1
                out = f"\n{lists[-1]}. "
        elif name == "ol" or name == "ul":
            lists.append(first)
        elif name == "/ol" or name == "/ul":
            if lists:
                lists.pop()
        elif name == "tr":
            cells = 0
        elif name == "/tr":
            if below_head:
                out = "\n" + "|".join(["---"] * cells) + "\n"
            below_head, cells = False, 0
        elif name != "/li":
            below_head = name == "table"
        pieces[i] = out
    return "".join(pieces)


@F.pandas_udf(StringType())
def _with_structure(texts: pd.Series) -> pd.Series:
    return texts.map(_structured, na_action="ignore")


def _marked(text: Column) -> Column:
    """Items of ordered lists numbered, cells of a table parted by ``|``, its first row underlined.

    A fold over the tags with a stack of open lists. Only texts that hold such tags are sent to Python.
    """
    tagged = _once(text, lambda t: F.when(t.rlike(r"(?i)<(ol|tr|td|th)\b"), t))
    return F.coalesce(_with_structure(tagged), text)


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def clean_html(c: Column | str) -> Column:
    """HTML body to one lower-case line of text; null gives empty text.

    Items of ordered lists carry their number, from ``start`` if that is given; the cells of a table row are parted by
    ``|`` and its first row is followed by ``---|---``.
    """
    below = HIDDEN_STEPS + HEADING_STEPS
    text = _marked(_replaced(blank_if_null(c), HTML_STEPS[:HIDDEN_STEPS]))
    # Most texts hold no heading, which one look tells.
    text = _once(text, lambda t: F.when(t.rlike("<[hH][1-6]"), _replaced(t, HTML_STEPS[HIDDEN_STEPS:below])).otherwise(t))
    text = decode_entities(_replaced(text, HTML_STEPS[below:]))
    text = _replaced(text, TEXT_STEPS)
    return F.lower(F.trim(text))


def normalize_title(c: Column | str, strict: bool = True) -> Column:
    """Lower-case title without level words; null gives empty text.

    ``strict`` tries the level words in their given order, so ``mid-level`` leaves
    ``-level`` behind; without it the longer words are tried first.
    """
    levels = LEVEL_WORDS if strict else sorted(LEVEL_WORDS, key=len, reverse=True)
    text = strip(F.lower(blank_if_null(c)))
    text = F.regexp_replace(text, r"\b(" + "|".join(levels) + r")\b", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(blank_if_null(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def normalize_keyword(c: Column | str) -> Column:
    """Words in lower case joined by ``_``: ``"Computer Science"`` becomes ``computer_science``."""
    return F.array_join(tokens(c), "_")


def ngrams(words: Column, n_max: int = 3) -> Column:
    """All runs of 1 to ``n_max`` neighbouring words, joined by ``_``."""

    def of(w: Column) -> Column:
        runs = [w]
        for n in range(2, n_max + 1):
            longer = F.greatest(F.size(w) - (n - 1), F.lit(0))
            runs.append(F.zip_with(
                F.slice(runs[-1], F.lit(1), longer), F.slice(w, F.lit(n), longer), lambda a, b: F.concat(a, F.lit("_"), b)
            ))
        return F.concat(*runs)

    return _once(words, of)
