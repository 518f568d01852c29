"""The numbered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.bpe import bpe_encode
from topicloom.llm.common import documents, written
from topicloom.llm.fingerprint import fingerprint_edits
from topicloom.llm.line_dedup import remove_repeated_lines
from topicloom.llm.neighbours import nearest_neighbours
from topicloom.llm.packing import harmonic_pack
from topicloom.llm.prefix_trie import conversation_trie
from topicloom.llm.quality import fit_discriminant, quality, with_statistics
from topicloom.llm.rank_array import rank_array_encode
from topicloom.llm.set_join import similar_classes
from topicloom.llm.shards import in_shards, token_sequences
from topicloom.llm.sql import JACCARD_CLASSES, PREFIX_TRIE, REPEATED_LINES, REPEATED_PASSAGES, STRUCTURE_REPAIR
from topicloom.llm.structure_repair import damaged, digest_of_turns, repair_conversations
from topicloom.llm.substring_dedup import remove_repeated_passages
from topicloom.llm.toxicity import fit_toxicity, held_out, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op1_byte_bpe")
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe_encode(documents(spark, sf_dir), ranks, pattern, decode=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op4_harmonic_packing")
def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = harmonic_pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op7_jaccard_join", JACCARD_CLASSES)
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(documents(spark, sf_dir), n=3, similarity_percent=90)


@query("op9_substring_dedup", REPEATED_PASSAGES)
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(documents(spark, sf_dir), window=13).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@query("op6_line_dedup", REPEATED_LINES)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "lines_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out("doc_id", 3, 1)
    model = fit_toxicity(docs, labels(spark, sf_dir).where(~out))
    scored = docs.select("doc_id", out.alias("held_out"), toxicity(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", 5, 0)
    described = with_statistics(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "statistics")
    described = written(described, "statistics")
    train = described.join(labels(spark, sf_dir).where(~out).select("doc_id", F.col("quality").alias("label")), "doc_id")
    model = fit_discriminant(train)
    scored = described.select("doc_id", out.alias("held_out"), quality(model, F.col("statistics")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), query_every=100)


@query("op2_training_order")
def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = token_sequences(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=49407, key=20240117)
    return in_shards(placed, per_shard=4096).select(
        "shard", "record", "slot", "doc_id", "part", "n_tokens", F.sha2("bytes", 256).alias("bytes_sha256")
    )


@query("op11_rank_array_bpe")
def op11_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = rank_array_encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@query("op12_prefix_trie", PREFIX_TRIE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(conversations(spark, sf_dir))


@query("op13_structure_repair", STRUCTURE_REPAIR)
def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, turns = repair_conversations(damaged(conversations(spark, sf_dir)))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return report.join(digest_of_turns(turns), "conv_id", "left").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )
