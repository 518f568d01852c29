"""What the operators of this subpackage share: slicing of Arrow batches, word hashes, written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.runtime import scratch_path

#: Text bytes that a Python worker handles at once. Whole rows only: a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that memory follows the longest text at most."""
    for batch in batches:
        sizes = [0 if v is None else v for v in pc.binary_length(batch.column(text)).to_pylist()]
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def ascii_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs of bytes other than blank and 0x09 to 0x0D; ``lower`` folds A-Z alone. Null has none."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    if seed:
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finishing step of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` word hashes, in order; none if there are fewer words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = words[:count].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k:k + count])
    return mix(out)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a short lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of ``written`` tables that nothing reads any more."""
    for table in tables:
        for folder in {path.rsplit("/", 1)[0] for path in table.inputFiles()}:
            where = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str, blank: bool = True) -> DataFrame:
    """Just the two columns an operator reads, so that no other column can clash; null texts become empty."""
    text = F.col(text_col).cast("string")
    # Without an alias of the same name, equal shuffles of two branches of a plan are seen to be equal and made once.
    number = F.col(id_col) if id_col == "doc_id" else F.col(id_col).alias("doc_id")
    return df.select(number, (F.coalesce(text, F.lit("")) if blank else text).alias("text"))
