"""Topic classification of texts by phrase matching against the ontology."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.constants import TOPICS_PER_PAPER
from topicloom.functions.columns import join_text
from topicloom.functions.text import ngrams, normalize_keyword, tokens
from topicloom.operators.fuzzy import fuzzy_match
from topicloom.operators.topk import top_k_per_key
from topicloom.runtime import cut_lineage, has_at_most

FEW_PHRASES = 200_000  # vocabulary entries that are broadcast as an automaton; beyond that they are joined

_automata: dict[int, ahocorasick.Automaton] = {}


def vocabulary(topics: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """``(phrase, topic)`` from topic names (column ``name``) and ``synonyms(synonym, topic)``."""
    phrases = topics.select(normalize_keyword("name").alias("phrase"), F.col("name").alias("topic"))
    if synonyms is not None:
        phrases = phrases.unionByName(synonyms.select(normalize_keyword("synonym").alias("phrase"), "topic"))
    return phrases.where(F.col("phrase") != "").distinct()


def with_near_phrases(
    vocab: DataFrame, papers: DataFrame, text_cols: Sequence[str] = ("title", "abstract", "keywords"), max_dist: int = 1, least: int = 8
) -> DataFrame:
    """``vocab`` and, for every phrase, its spellings in the texts of ``papers`` with one word at most ``max_dist`` edits off.

    Only words of ``least`` characters in the vocabulary have other spellings, and a word or phrase that is in the
    vocabulary itself never counts as another one. A spelling near several topics counts for all of them. The words of
    the texts are made distinct before they meet the vocabulary, so the work grows with their variety, not their number.
    """
    if max_dist < 1:
        return vocab
    places = vocab.select("phrase", "topic", F.posexplode(F.split("phrase", "_")).alias("at", "word"))
    stated = places.select("word").distinct()
    used = papers.select(F.explode(tokens(join_text(*text_cols))).alias("keyword")).where(F.length("keyword") >= least - max_dist)
    unknown = used.distinct().join(stated, F.col("keyword") == F.col("word"), "left_anti")
    near = fuzzy_match(unknown, stated.where(F.length("word") >= least).withColumnRenamed("word", "name"), max_dist)
    spelt = places.join(near.select("keyword", F.col("topic").alias("word")), "word").select(
        F.array_join(F.transform(F.split("phrase", "_"), lambda w, i: F.when(i == F.col("at"), F.col("keyword")).otherwise(w)), "_").alias("phrase"),
        "topic",
    )
    return vocab.select("phrase", "topic").unionByName(spelt).distinct()


def classify_topics(
    papers: DataFrame,
    vocab: DataFrame,
    subtopic_of: DataFrame,
    k: int | None = TOPICS_PER_PAPER,
    key: str = "eid",
    text_cols: Sequence[str] = ("title", "abstract", "keywords"),
    n_max: int | None = None,
    include_direct: bool = True,
    near: int = 0,
) -> DataFrame:
    """Topics per paper as ``key, topic, score, rank``: at most ``k``, by (score desc, topic).

    The score counts the occurrences of the names and synonyms of a topic in the whole text,
    and every occurrence also counts for the direct parents of the topic. Without
    ``include_direct`` only topics reached as parents are kept. ``subtopic_of`` holds
    ``src`` (child) and ``dst`` (parent).

    Parents are added to the vocabulary rather than to the hits, so the text is split once
    and hits are summed in one shuffle. With ``n_max`` longer phrases are left out. A vocabulary
    of checked size becomes one automaton, and every text is walked once whatever the length of
    phrases; with a larger one all runs of words, counted per paper, are joined with it. Papers
    without a key keep it; null texts hold nothing. With ``near`` a phrase is also found where one
    of its longer words is up to so many edits off, see ``with_near_phrases``.
    """
    if near:
        vocab = cut_lineage(with_near_phrases(vocab, papers, text_cols, near))
    if n_max is not None:
        vocab = vocab.where(F.size(F.split("phrase", "_")) <= n_max)
    direct = vocab.select("phrase", "topic", F.lit(1).alias("weight"), F.lit(1).alias("direct"))
    above = vocab.join(subtopic_of, vocab["topic"] == subtopic_of["src"]).select(
        "phrase", F.col("dst").alias("topic"), F.lit(1).alias("weight"), F.lit(0).alias("direct")
    )
    entries = (
        direct.unionByName(above)
        .groupBy("phrase", "topic")
        .agg(F.sum("weight").alias("weight"), F.max("direct").alias("direct"))
    )
    words = tokens(join_text(*text_cols))
    if has_at_most(entries, FEW_PHRASES):
        hits = _found(papers.select(F.col(key), F.concat(F.lit("_"), F.array_join(words, "_"), F.lit("_")).alias("text")), entries, key)
    else:
        longest = n_max or vocab.agg(F.max(F.size(F.split("phrase", "_")))).first()[0] or 1
        grams = papers.select(key, F.explode(ngrams(words, longest)).alias("phrase"))
        counted = grams.groupBy(key, "phrase").agg(F.count("*").alias("times"))
        hits = counted.join(entries, "phrase").withColumn("weight", F.col("weight") * F.col("times"))
    scored = hits.groupBy(key, "topic").agg(F.sum("weight").alias("score"), F.max("direct").alias("direct"))
    if not include_direct:
        scored = scored.where(F.col("direct") == 0)
    scored = scored.drop("direct")
    return scored if k is None else top_k_per_key(scored, key, [F.desc("score"), "topic"], k)


def _automaton(number: int, phrases: list[str]) -> ahocorasick.Automaton:
    """The automaton of a broadcast vocabulary, built once per worker. A value is the place of a phrase in the list."""
    if number not in _automata:
        _automata.clear()
        automaton = ahocorasick.Automaton()
        for at, phrase in enumerate(phrases):
            automaton.add_word(f"_{phrase}_", at)
        automaton.make_automaton()
        _automata[number] = automaton
    return _automata[number]


def _found(texts: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``key, topic, weight, direct``: the entries found in every text of ``key, text``, summed per text and topic.

    Words of a text stand between ``_``, and so do phrases, so a phrase is found at words only and phrases may overlap.
    """
    known: dict[str, list[tuple[str, int, int]]] = {}
    for r in entries.collect():
        known.setdefault(r["phrase"], []).append((r["topic"], r["weight"], r["direct"]))
    shared = texts.sparkSession.sparkContext.broadcast((list(known), list(known.values())))
    number = uuid.uuid4().int  # workers outlive a vocabulary
    kind = texts.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, values = shared.value
        automaton = _automaton(number, phrases) if phrases else None
        for batch in batches:
            rows: list[int] = []
            topics: list[str] = []
            weights: list[int] = []
            directs: list[int] = []
            for row, text in enumerate(batch.column(1).to_pylist() if automaton else []):
                times = Counter(at for _, at in automaton.iter(text))
                sums: dict[str, tuple[int, int]] = {}
                for at, n in times.items():
                    for topic, weight, direct in values[at]:
                        before = sums.get(topic, (0, 0))
                        sums[topic] = before[0] + weight * n, max(before[1], direct)
                rows += [row] * len(sums)
                topics += sums
                weights += [w for w, _ in sums.values()]
                directs += [d for _, d in sums.values()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(topics, pa.string()), pa.array(weights, pa.int64()), pa.array(directs, pa.int32())],
                names=[key, "topic", "weight", "direct"],
            )

    return texts.mapInArrow(walk, f"`{key}` {kind}, topic string, weight long, direct int")
