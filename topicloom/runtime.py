"""Where shared files go, and how lineage is cut so that a lost executor costs little."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may do without the setting; it then gets a temporary folder.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="topicloom-")
    return _local_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/topicloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    As ``cut_lineage``, but what is read has a known size, so that small steps are broadcast, and is computed once.
    """
    path, schema = scratch_path(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables that nothing reads any more."""
    for table in tables:
        sc = table.sparkSession.sparkContext
        for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
            where = sc._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove shuffle files that no plan needs any more; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Check a size bound; counts no further than it needs to."""
    return df.limit(rows + 1).count() <= rows
