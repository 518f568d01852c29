"""Toxicity by weak supervision.

Voters are groups of lexicon entries (whole words, and beginnings of words, that mark toxic training texts) and
patterns (how many entries, how dense, capitals, exclamation marks, repeats). A generative model of the votes
estimates how often each voter fires on toxic and on other texts and how voters correlate beyond that; the human label
of a training row is one voter more, as labels have errors, too. Its posteriors are what a linear classifier is
trained on. Only that classifier scores texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import slices, written

WORD = re.compile(r"\w+")
HEAD = 4  # the part of a word by which entries are looked up; shorter words are looked up whole
BEGINNINGS = (4, 5, 6)
GROUPS = 12  # lexicon voters


@dataclass
class Model:
    terms: dict[str, tuple[int, float]]  # entry, with a closing "*" if it is a beginning -> group, log of its lift
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the constant


def entries_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) > n}


class Reader:
    """Votes and features of a text under a lexicon."""

    def __init__(self, terms: dict[str, tuple[int, float]]):
        self.heads: dict[str, list[str]] = {}
        for term in terms:
            self.heads.setdefault(term[:HEAD], []).append(term)
        self.terms = terms

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        words = WORD.findall(text.lower())
        groups, hits, distinct, lift = np.zeros(GROUPS), 0, set(), 0.0
        heads = self.heads
        for word in words:
            if (found := heads.get(word[:HEAD])) is not None:
                best = 0.0
                for term in found:
                    if word == term or term[-1] == "*" and len(word) >= len(term) and word.startswith(term[:-1]):
                        group, weight = self.terms[term]
                        groups[group] = 1
                        if weight > best:
                            best = weight
                            distinct.add(term)
                if best:
                    hits += 1
                    lift += best
        count = max(1, len(words))
        upper = len(re.findall(r"[A-Z]", text)) / max(1, len(text))
        bangs = text.count("!") / count
        same = sum(a == b for a, b in zip(words, words[1:])) / count
        votes = np.concatenate([groups, [hits >= 2, hits >= 4, hits > 0.004 * count, upper > 0.5, bangs > 0.2, same > 0.3]])
        share = 100 * hits / count
        features = np.concatenate([
            [np.log1p(hits), np.log1p(share), np.log1p(len(distinct)), np.log1p(lift), hits > 0, hits > 1, upper > 0.5, bangs > 0.2, same > 0.3],
            [np.log1p(groups.sum())],
        ])
        return votes.astype(float), features.astype(float)


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of the hidden label per row, by expectation maximisation over the votes (0 or 1, a column per voter).

    A voter fires with one probability on toxic rows and with another on the others. Given the label, voters that
    still correlate say the same thing twice: a voter's say is divided by one plus its positive residual correlations.
    """
    q = start
    for _ in range(rounds):
        n1, n0 = q.sum(), (1 - q).sum()
        fire1, fire0 = (q @ votes + 1) / (n1 + 2), ((1 - q) @ votes + 1) / (n0 + 2)
        residual = votes - q[:, None] * fire1 - (1 - q)[:, None] * fire0
        spread = np.sqrt((residual**2).mean(0)) + 1e-9
        correlation = np.clip((residual / spread).T @ (residual / spread) / len(votes), 0, 1)
        np.fill_diagonal(correlation, 0)
        say = 1 / (1 + correlation.sum(1))
        odds = votes @ (say * np.log(fire1 / fire0)) + (1 - votes) @ (say * np.log((1 - fire1) / (1 - fire0)))
        new = 1 / (1 + np.exp(-np.clip(odds + np.log(prior / (1 - prior)), -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            return new
        q = new
    return q


def linear_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression on soft targets by Newton's method, with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - target)) + keep * w
        curve = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """Distinct texts of at most ``most`` rows of either label, by the hash of their id, and how many rows there are."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("id is not null and label in (0, 1)")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = [known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(most) for v in (0, 1)]
    drawn = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * most rows
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(drawn, "id")
    return rows.select("label", "text"), counts


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    most_rows: int = 6000, most_terms: int | None = None, least_texts: int = 4, least_lift: float = 14.0,
) -> Model:
    """Learn from labelled rows; ``labels`` must hold the training rows alone.

    At most ``most_rows`` rows of each label are used, drawn by the hash of their id. Rows without id or label are
    left out. Where no toxic or no other label meets a document, every text scores the share of toxic labels, next to
    0 without any. The lexicon holds all terms in ``least_texts`` toxic texts of the sample with a lift of
    ``least_lift`` at least, or, if ``most_terms`` is given, as many of the largest count times log of lift. Repeated
    rows of a text count once, as toxic if one is. Other columns of either table are not read.
    """
    rows, counts = _sampled(docs, labels, id_col, text_col, label_col, most_rows)
    prior = (counts.get(1, 0) + 1e-3) / (sum(counts.values()) + 2e-3) if counts else 1e-3
    constant = Model({}, np.zeros(10), np.ones(10), np.append(np.zeros(10), np.log(prior / (1 - prior))))
    if not counts.get(1) or not counts.get(0):
        return constant
    texts = rows.groupBy("text").agg(F.max("label").alias("label"))
    texts = written(texts, "labelled-texts")

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen = {0: Counter(), 1: Counter()}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                seen[label].update(entries_of(text))
            for label, found in seen.items():
                n, none = pa.array(found.values(), pa.int64()), pa.array([0] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.string()), *([n, none] if label else [none, n])], names=["term", "n", "others"])

    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return constant
    counted = texts.select("label", "text").mapInArrow(count_terms, "term string, n bigint, others bigint")
    counted = counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("others").alias("others")).where(F.col("n") >= least_texts)
    # Terms are ranked when their lift is known: frequent terms without a lift take no place.
    lift = (F.col("n") + 0.5) / (sizes.get(1, 0) + 1) * (sizes.get(0, 0) + 1) / (F.col("others") + 0.5)
    marks = counted.withColumn("lift", lift).where(F.col("lift") >= least_lift)
    marks = marks.orderBy(F.desc(F.col("n") * F.log("lift")), "term")
    best = (marks if most_terms is None else marks.limit(most_terms)).collect()  # no more than the sample's terms
    terms = {r["term"]: (k % GROUPS, float(np.log(r["lift"]))) for k, r in enumerate(best)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms)
        for batch in slices(batches):
            both = [reader.read(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("label"), pa.array([v.tolist() for v, _ in both], pa.list_(pa.float64())),
                pa.array([f.tolist() for _, f in both], pa.list_(pa.float64())),
            ], names=["label", "votes", "features"])

    got = texts.select("label", "text").mapInArrow(read, "label int, votes array<double>, features array<double>").collect()
    label = np.array([r["label"] for r in got], float)
    votes, features = np.array([r["votes"] for r in got]), np.array([r["features"] for r in got])
    # Rows weigh as much as their label does among all labelled rows.
    share = label.mean()
    weight = np.where(label == 1, prior / share, (1 - prior) / (1 - share))
    posterior = label_model(np.column_stack([votes, label]), share, np.where(label == 1, 0.9, 0.1))
    mean, scale = features.mean(0), features.std(0) + 1e-6
    return Model(terms, mean, scale, linear_classifier((features - mean) / scale, posterior, weight))


def toxicity(model: Model, text: Column) -> Column:
    """Score from 0 to 1 of a text column, null and empty texts included: the classifier's probability of label 1."""
    held = model

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(held.terms)
        for texts in batches:
            x = np.array([reader.read(t)[1] for t in texts]).reshape(-1, len(held.mean))
            z = (x - held.mean) / held.scale @ held.weights[:-1] + held.weights[-1]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return F.pandas_udf(score, "double")(text)


def held_out(id_col: str, parts: int, held: int) -> Column:
    """Whether the crc32 of the id as text leaves the remainder of the rows kept for the test; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == held, F.lit(False))
