"""Node and edge sets stored in buckets of their keys, so that an upsert rewrites only the buckets it touches.

A set lies in ``<path>/buckets=<count>/bucket=<number>/version=<number>``. A version of a bucket is written elsewhere
and gets its place by one rename, so readers see the old or the new rows of a bucket and never none. They take the
newest version; the one before it stays for readers that have planned already, until the bucket is rewritten again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators.upsert import merge_rows
from topicloom.runtime import forget, stored

BUCKET = "_bucket"


class _Version(NamedTuple):
    buckets: int
    bucket: int
    version: int
    path: str


def _hadoop(spark: SparkSession, path: str):
    """The file system of ``path`` and a maker of paths."""
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path


def _versions(spark: SparkSession, path: str) -> dict[int, list[_Version]]:
    """Versions of each bucket, oldest first: names of folders, two or three a bucket."""
    files, to_path = _hadoop(spark, path)
    found: dict[int, list[_Version]] = {}
    for status in files.globStatus(to_path(f"{path.rstrip('/')}/buckets=*/bucket=*/version=*")) or ():
        folder = status.getPath().toString()
        numbers = [int(part.partition("=")[2]) for part in folder.split("/")[-3:]]
        found.setdefault(numbers[1], []).append(_Version(*numbers, folder))
    return {bucket: sorted(versions) for bucket, versions in found.items()}


def _read(spark: SparkSession, versions: Sequence[_Version]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*[v.path for v in versions])


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the set at ``path``; a set that was never written, or only without rows, is an error."""
    newest = [versions[-1] for versions in _versions(spark, path).values()]
    if not newest:
        raise FileNotFoundError(f"no buckets in {path}")
    return _read(spark, newest)


def upsert_buckets(new: DataFrame, path: str, keys: Sequence[str], order: str | None = None, buckets: int = 64) -> DataFrame:
    """Merge ``new`` into the set at ``path`` by ``keys``, and return all rows of the set.

    Rows are merged as by ``upsert_nodes``: whole new rows, nulls filled from the old row, one row per key; rows with a
    null in a key are left out. Only buckets that hold a key of ``new`` are read and written. A set keeps the number of
    ``buckets`` it began with; choose it so that a bucket is some hundreds of MB. Columns that are new to the set are null
    in old rows. A run that stops between two renames has merged some buckets, and running it again merges the rest.
    One writer at a time.
    """
    spark, root = new.sparkSession, path.rstrip("/")
    files, to_path = _hadoop(spark, path)
    before = _versions(spark, path)
    rows = new
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    if before:
        buckets = next(iter(before.values()))[0].buckets
        kinds = dict(_read(spark, [versions[-1] for versions in before.values()]).dtypes)
        # A number is hashed by its type, so keys take the type they are stored with.
        rows = rows.withColumns({c: F.col(c).cast(kinds[c]) for c in rows.columns if c in kinds})
    rows = stored(rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "upsert")
    touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
    known = [before[b][-1] for b in touched if b in before]
    old = None
    if known:
        old = _read(spark, known).withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    staged = f"{root}/_staged-{uuid.uuid4().hex}"
    # Repeated keys are folded before rows move to the task of their bucket, so no key makes a long task.
    merged = merge_rows(old, rows, [BUCKET, *keys], order)
    merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(staged)
    for b in touched:
        versions = before.get(b, [])
        place = to_path(f"{root}/buckets={buckets}/bucket={b}/version={versions[-1].version + 1 if versions else 1}")
        files.mkdirs(place.getParent())
        if files.exists(place) or not files.rename(to_path(f"{staged}/{BUCKET}={b}"), place):
            raise OSError(f"could not put a bucket at {place}; does another upsert run?")
        for older in versions[:-1]:
            files.delete(to_path(older.path), True)
    files.delete(to_path(staged), True)
    result = read_buckets(spark, path) if before or touched else merged.drop(BUCKET).limit(0)
    forget(rows)
    return result
