"""Removal of repeated runs of lines, cut where their content says so; built-in functions only.

A rolling hash over the hashes of two lines in a row says whether the two are a boundary. A chunk reaches from one
boundary to the next and holds the lines of both, so whatever decides where it starts and ends lies inside of it: a block
of lines has the same chunks amid any other text, and neighbouring chunks share lines. Chunks are counted by their md5
over all documents; of those that repeat, every chunk but the first is compared with the first byte by byte and cut out
if it is equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import written

BASE = 1_000_003  # of the rolling hash
SHIFT = 13  # its low bits are not used
TWO_FILLED_LINES = r"[^\x20\x09-\x0D][^\n]*\n[\x20\x09-\x0D]*[^\x20\x09-\x0D]"
COPIES = 512  # of one chunk that are compared with one replica of its first text


def line_hash(line: Column) -> Column:
    """The first 32 bits of the md5, as SQL engines can compute it, too."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _with_boundaries(df: DataFrame, passed_over: int) -> DataFrame:
    """Add ``lines`` and ``ends``, the positions of the second lines of boundaries, and the first and last line.

    Expressions in lambdas name a column of the projection below at least twice; Spark then computes that column once
    per row and not once per element.
    """
    df = df.withColumn("lines", F.split("text", "\n", -1))
    df = df.withColumn("hashes", F.transform("lines", line_hash))
    before = F.concat(F.array(F.lit(0).cast("bigint")), F.slice("hashes", F.lit(1), F.size("hashes") - 1))
    rolled = F.zip_with("hashes", before, lambda h, p: F.shiftright(p * BASE + h, SHIFT) % passed_over)
    chosen = lambda r, i: (r != 0) | (i == 0) | (i == F.size("hashes") - 1)
    ends = F.filter(F.transform(rolled, lambda r, i: F.when(chosen(r, i), i).otherwise(-1)), lambda i: i >= 0)
    return df.withColumn("ends", ends).drop("hashes")


def _text_of(lines: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(lines, start + 1, F.least(size, F.size(lines))), "\n")


def remove_repeated_lines(
    df: DataFrame, passed_over: int = 4, id_col: str = "doc_id", text_col: str = "text",
    removed_col: str = "lines_removed",
) -> DataFrame:
    """The rows of ``df`` with repeated chunks of lines cut out of the text, and ``removed_col``, how many lines went.

    Two lines in a row are a boundary unless their rolling hash is divisible by ``passed_over``, so that three windows in
    four are one and most chunks have three or four lines; the first and the last line of a text are boundaries, too. The
    first chunk, by id and line number, stays, but for lines that it shares with a chunk that goes: of lines that repeat
    over and over without a break the first period stays. Chunks with fewer than two lines that hold more than blanks are
    never cut out. A text whose chunks are all repeated becomes empty, its row stays; a text that loses nothing is as it
    was, a null text stays null. Rows that repeat an id are one document: what is a first chunk stays in each of them, and
    where their texts differ a repeated line may stay as well. Rows without an id lose nothing and take nothing. Other
    columns stay as they are, but for one named ``removed_col``, which is replaced.
    """
    others = [c for c in df.columns if c not in (text_col, removed_col)]
    source = df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")] if others != [id_col] else []),
    )
    docs = source.where(F.col("doc_id").isNotNull())

    cut = _with_boundaries(docs.where(F.col("text").isNotNull()).select("doc_id", "text"), passed_over)
    following = F.slice("ends", F.lit(2), F.greatest(F.size("ends") - 1, F.lit(0)))
    starts = F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda e: F.greatest(e - 1, F.lit(0)))
    chunks = F.zip_with(starts, following, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("size")))
    cut = cut.select("doc_id", "lines", chunks.alias("chunks"))
    whole = F.transform("chunks", lambda c: F.struct(
        c["start"].alias("start"), c["size"].alias("size"), _text_of(F.col("lines"), c["start"], c["size"]).alias("of"),
    ))
    keyed = F.transform(F.filter(whole, lambda c: c["of"].rlike(TWO_FILLED_LINES)), lambda c: F.struct(
        c["start"].alias("start"), c["size"].alias("size"), F.unhex(F.md5(c["of"].cast("binary"))).alias("key"),
    ))
    chunks = written(cut.select("doc_id", F.inline(keyed)), "line-chunks")

    # A chunk with many copies has a replica of its first text for every so many of them, each on a key of its own.
    repeated = chunks.groupBy("key").agg(
        F.min(F.struct("doc_id", "start", "size")).alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("key", "first", F.floor(F.col("n") / COPIES).cast("int").alias("more"))
    copies = chunks.join(repeated, "key").where(
        (F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start"))
    ).select("key", F.pmod(F.xxhash64("doc_id", "start"), F.col("more") + 1).cast("int").alias("replica"), "doc_id", "start", "size")
    # A document's first chunks stand together: its text is split once for all of them.
    wanted = repeated.groupBy(F.col("first.doc_id").alias("doc_id")).agg(
        F.collect_list(F.struct("key", "more", F.col("first.start").alias("start"), F.col("first.size").alias("size"))).alias("firsts")
    )
    texts = docs.join(wanted, "doc_id").select("firsts", F.split("text", "\n", -1).alias("lines")).select(
        F.inline(F.transform("firsts", lambda c: F.struct(
            c["key"].alias("key"), c["more"].alias("more"), _text_of(F.col("lines"), c["start"], c["size"]).alias("bytes")
        )))
    ).select("key", "bytes", F.explode(F.sequence(F.lit(0), "more")).alias("replica"))
    gone = copies.join(texts, ["key", "replica"]).groupBy("doc_id").agg(
        F.collect_set(F.struct("start", "size", "bytes")).alias("gone")
    )

    rest = docs.join(gone, "doc_id", "left").withColumn(
        "lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n", -1))
    )
    equal = F.filter("gone", lambda c: _text_of(F.col("lines"), c["start"], c["size"]) == c["bytes"])
    rest = rest.withColumn("equal", F.array_sort(F.transform(equal, lambda c: F.struct(c["start"], c["size"]))))
    kept_from = F.concat(F.array(F.lit(0)), F.transform("equal", lambda c: c["start"] + c["size"]))
    kept_to = F.concat(F.transform("equal", lambda c: c["start"]), F.array(F.size("lines")))
    length = lambda a, b: F.greatest(F.least(b - a, F.size("lines")), F.lit(0))
    kept = F.flatten(F.zip_with(kept_from, kept_to, lambda a, b: F.slice(F.col("lines"), a + 1, length(a, b))))
    stayed = F.aggregate(F.zip_with(kept_from, kept_to, length), F.lit(0), lambda n, k: n + k)
    done = rest.withColumns({
        "n": F.when(F.size("equal") > 0, F.size("lines") - stayed).otherwise(0).cast("bigint"),
        "text": F.when(F.size("equal") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")),
    }).drop("gone", "lines", "equal")
    done = done.unionByName(source.where(F.col("doc_id").isNull()).withColumn("n", F.lit(0).cast("bigint")))
    value = {c: F.col("others")[c] if "others" in done.columns else F.col("doc_id") for c in others}
    return done.select(
        *[(F.col("text") if c == text_col else value[c]).alias(c) for c in df.columns if c != removed_col],
        F.col("n").alias(removed_col),
    )
