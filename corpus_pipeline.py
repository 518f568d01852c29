"""The training-data pipeline: every stage works on what the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import documents, written
from topicloom.llm.line_dedup import remove_repeated_lines
from topicloom.llm.packing import harmonic_pack
from topicloom.llm.set_join import similar_classes
from topicloom.llm.substring_dedup import remove_repeated_passages
from topicloom.llm.toxicity import fit_toxicity, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7; the classifier learns from all labelled documents among them."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity(model, F.col("text")) < 0.7)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of lines that an earlier document, or an earlier place, holds."""
    kept = remove_repeated_lines(docs)
    return _with_length(kept.drop("lines_removed"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every class of similar texts: five words, similarity of 0.8."""
    classes = similar_classes(docs.select("doc_id", "text"), n=5, similarity_percent=80)
    kept = classes.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a document of smaller id holds; texts that lose nothing keep their line ends."""
    cut = remove_repeated_passages(docs, with_rows=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    kept = cut.select(*[(text if c == "text" else F.col("others")[c]).alias(c) for c in docs.columns])
    return _with_length(kept)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return harmonic_pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("substring dedup", cut_repeated_passages),
    ("packing", pack),
]

#: The learnt stage and the tokenizer have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
