"""Readers. Schemas are declared by default; CSV inference is left as an option."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from topicloom.functions.columns import strip
from topicloom.runtime import cut_lineage, has_at_most, stored
from topicloom.schemas import HIERARCHY, TRIPLES

BAD_ROW = "_bad_row"
MOST_BLOCKS = 100_000  # splits whose few numbers are broadcast


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    sep: str = ",",
    names: Sequence[str] | None = None,
    bad_rows: str = "null",
    multiline: bool = False,
    recursive: bool = False,
) -> DataFrame:
    """CSV with a header, or headerless when ``names`` are given.

    Without ``schema`` and ``names`` the types are inferred, which reads the data twice.
    ``bad_rows`` is ``"null"`` (fill with nulls), ``"drop"``, ``"fail"``, or ``"keep"``,
    which adds the raw text of a malformed row as column ``_bad_row``. Unless bad rows are
    filled, rows are parsed whole, so that what counts as bad does not depend on the columns
    selected later.
    """
    if names is not None and schema is None:
        schema = StructType([StructField(n, StringType()) for n in names])
    modes = {"null": "PERMISSIVE", "keep": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}
    reader = (
        spark.read.option("header", names is None)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("recursiveFileLookup", recursive)
        .option("mode", modes[bad_rows])
        .option("columnPruning", bad_rows == "null")
        .option("enforceSchema", names is not None or schema is None)
    )
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if bad_rows == "keep":
        schema = StructType([*schema.fields, StructField(BAD_ROW, StringType())])
        reader = reader.option("columnNameOfCorruptRecord", BAD_ROW)
    return reader.schema(schema).csv(path)


def read_csv_in_splits(
    spark: SparkSession,
    path: str,
    schema: StructType,
    sep: str = ",",
    header: bool = True,
    bad_rows: str = "null",
    recursive: bool = False,
) -> DataFrame:
    """CSV whose quoted fields may hold line ends, with every file read by many tasks.

    A quote inside of a field is doubled, and fields that hold quotes are quoted. Then a line is the first of a record if
    the number of quotes before it in its file is even. One pass counts the lines with an odd number of quotes per split;
    their running sum over the splits of a file says whether a split begins inside of a record, and in which split that
    record was opened. The second pass puts records together while lines stream by; only those that cross a split move.
    A record that is open at the end of its file is a record as it stands. Blank records are passed over, so is the first
    record of a file if there is a ``header``; ``bad_rows`` is as for ``read_csv``.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    turns = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    lines = lines.withColumn("turns", turns.cast("int"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("turns").alias("turns")).withColumn(
        "inside", (F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2).cast("int"))
    opens = (F.col("turns") > 0) & ((F.col("inside") + F.col("turns")) % 2 == 1)
    blocks = stored(blocks.withColumn(
        "opened", F.last(F.when(opens, F.col("block")), ignorenulls=True).over(before)).drop("turns"), "csv-blocks")

    # Lines must come in the order of the file: a small side is broadcast, beyond that the lines are sorted.
    if has_at_most(blocks, MOST_BLOCKS):
        placed = lines.join(F.broadcast(blocks), ["file", "block"])
    else:
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(blocks, ["file", "block"]).repartition(
            "file", "block").sortWithinPartitions("file", "block", "at")
    columns = ["value", "file", "block", "turns", "inside", "opened"]
    pieces = stored(placed.select(*columns).mapInArrow(
        _records, "record string, file string, block bigint, opened bigint, first boolean"), "csv-records")
    whole = pieces.where("opened IS NULL").select("record", "first")
    crossing = pieces.where("opened IS NOT NULL").groupBy("file", "opened").agg(
        F.array_sort(F.collect_list(F.struct("block", "record"))).alias("parts"), F.max("first").alias("first"))
    records = whole.unionByName(crossing.select(F.array_join("parts.record", "\n").alias("record"), "first"))
    records = records.where(F.trim(F.regexp_replace("record", r"\r\z", "")) != "")
    if header:
        records = records.where(~F.col("first"))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST" if bad_rows == "fail" else "PERMISSIVE"}
    whole_schema = schema
    if bad_rows in ("keep", "drop"):
        whole_schema = StructType([*schema.fields, StructField(BAD_ROW, StringType())])
        options["columnNameOfCorruptRecord"] = BAD_ROW
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole_schema)
    # All columns are parsed, so that what is bad does not depend on those selected later.
    rows = records.select(F.from_csv(F.regexp_replace("record", r"\r\z", ""), ddl, options).alias("row")).select("row.*")
    return rows.where(F.col(BAD_ROW).isNull()).drop(BAD_ROW) if bad_rows == "drop" else rows


def _records(batches):
    """Lines in the order of their files to records; what reaches beyond its split has the split it was ``opened`` in."""
    at, held, opened, inside, first = None, [], None, 0, False

    def piece():
        return "\n".join(held), *at, opened, first

    for batch in batches:
        out = []
        for value, file, block, turns, begins_inside, opened_before in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != at:
                if held:
                    out.append(piece() if opened is not None else (*piece()[:3], at[1], first))
                at, held, inside, first = (file, block), [], begins_inside, block == 0
                opened = opened_before if inside else None
            held.append(value)
            inside = (inside + turns) % 2
            if not inside:
                out.append(piece())
                held, opened, first = [], None, False
        yield _as_batch(out)
    if held:
        yield _as_batch([piece() if opened is not None else (*piece()[:3], at[1], first)])


def _as_batch(rows):
    types = [("record", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("opened", pa.int64()), ("first", pa.bool_())]
    columns = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], [n for n, _ in types])


def split_bad_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Separate a frame read with ``bad_rows="keep"`` into good rows and raw bad lines.

    Spark does not scan for bad lines alone, so these are set aside with all their columns first.
    """
    bad = cut_lineage(df.where(F.col(BAD_ROW).isNotNull()))
    return df.where(F.col(BAD_ROW).isNull()).drop(BAD_ROW), bad.select(BAD_ROW)


def read_csv_tree(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    multiline: bool = True,
    names: Sequence[str] | None = None,
    with_source: bool = False,
    bad_rows: str = "null",
) -> DataFrame:
    """Every CSV file below ``path`` as one frame.

    ``with_source`` adds ``source_file`` and ``source_row``; the latter orders the rows of a file.
    A multi-line file is read by one task, so set ``multiline=False`` for large files without line
    ends inside of quotes, and take ``read_csv_in_splits`` for large files with them.
    """
    df = read_csv(
        spark, path, schema=schema, names=names, multiline=multiline, recursive=True, bad_rows=bad_rows
    )
    return with_source_position(df) if with_source else df


def with_source_position(df: DataFrame) -> DataFrame:
    """Add the file of each row and a value that grows along the file."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
        ).alias("source_row"),
    )


def read_xml_rows(spark: SparkSession, path: str, row_tag: str, schema: StructType, one_per_line: bool = False) -> DataFrame:
    """One row per ``row_tag`` element; attributes are columns with a leading underscore.

    A file is read by one task, unless ``one_per_line`` says that every element is a line of its own:
    then a large file is read in splits, and lines that are no such element are passed over.
    """
    if one_per_line:
        lines = spark.read.text(path).where(F.col("value").rlike(rf"^\s*<{re.escape(row_tag)}[\s/>]"))
        return lines.select(F.from_xml("value", schema).alias("row")).select("row.*")
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_embeddings(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Subject, predicate, object, trimmed; rows of another width are skipped.

    ``position`` keeps the order of the file for rules in which the last row wins.
    """
    df = read_csv(spark, path, schema=TRIPLES, names=TRIPLES.names, bad_rows="drop")
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select(*[strip(c).alias(c) for c in TRIPLES.names], position.alias("position"))


def read_hierarchy(spark: SparkSession, path: str, single_document: bool = False) -> DataFrame:
    """Parent-to-children JSON as rows ``parent, child``.

    One object per line is read in parallel; ``single_document`` reads files that hold one
    object spread over many lines.
    """
    text = spark.read.text(path, wholetext=single_document)
    return (
        text.select(F.explode(F.from_json("value", HIERARCHY)).alias("parent", "children"))
        .select("parent", F.explode("children").alias("child"))
        .distinct()
    )
