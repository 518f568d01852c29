"""Quality by regularised quadratic discriminant analysis of document statistics.

Each class is a normal distribution over transformed statistics of a text. Its covariance is shrunk towards the
diagonal of the pooled one. The score is the logistic function of the difference of log densities, from Mahalanobis
distances under Cholesky factors that are computed once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, SYMBOL, DIGIT, END = re.compile(r"[A-Z]"), re.compile(r"[#$%&*|<>=@~^\\/_{}\[\]]"), re.compile(r"[0-9]"), re.compile(r"[.!?]")
NAMES = (
    "words", "word length", "distinct", "repeated next", "capitals", "symbols", "digits", "exclamations", "line length",
    "repeated lines", "single-character words", "sentence length",
)


def statistics(text: str | None) -> list[float]:
    """Transformed statistics: logarithms of counts, log odds of shares. Any text has all of them."""
    text = text or ""
    words, lines = text.split(), text.split("\n")
    n, chars = len(words), max(1, len(text))

    def odds(share: float) -> float:
        return float(np.log((share + 0.002) / (1.002 - share)))

    return [
        float(np.log1p(n)), float(np.log1p(sum(map(len, words)) / max(1, n))), odds(len(set(words)) / max(1, n)),
        odds(sum(a == b for a, b in zip(words, words[1:])) / max(1, n)), odds(len(UPPER.findall(text)) / chars),
        odds(len(SYMBOL.findall(text)) / chars), odds(len(DIGIT.findall(text)) / chars), odds(text.count("!") / chars),
        float(np.log1p(n / len(lines))), odds(1 - len(set(lines)) / len(lines)),
        odds(sum(len(w) == 1 for w in words) / max(1, n)), float(np.log1p(n / (1 + len(END.findall(text))))),
    ]


def with_statistics(df: DataFrame, text_col: str = "text", out_col: str = "statistics") -> DataFrame:
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts], dtype=object)

    return df.withColumn(out_col, F.pandas_udf(describe, "array<double>")(F.col(text_col)))


@dataclass
class Discriminant:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # lower Cholesky factors
    constants: list[float]  # log prior less half the log determinant

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(constant - 0.5 * (z**2).sum(0))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -500, 500)))


def fit_discriminant(described: DataFrame, label_col: str = "label", shrinkage: float = 0.1, stats_col: str = "statistics") -> Discriminant:
    """Fit on all rows with label 0 or 1: only sums and sums of products leave the executors.

    A class of n rows is shrunk by ``shrinkage``, or by more if n is small. A class without rows gets the pooled
    distribution and a prior of next to nothing; without any row every text scores 0.5.
    """
    k = len(NAMES)
    x = [F.col(stats_col)[i] for i in range(k)]
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    sums += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    rows = described.where(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("label"))
    got = {r["label"]: r for r in rows.agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    counts, means, spreads = [], [], []
    for label in (0, 1):
        r = got.get(label)
        counts.append(r["n"] if r else 0)
        mean = np.array([r[f"s{i}"] / r["n"] for i in range(k)]) if r else np.zeros(k)
        second = np.zeros((k, k))
        if r:
            for i in range(k):
                for j in range(i, k):
                    second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        means.append(mean)
        spreads.append(second - np.outer(mean, mean) if r else np.zeros((k, k)))
    total = sum(counts)
    center = sum(c * m for c, m in zip(counts, means)) / max(1, total)
    pooled = sum(c * (s + np.outer(m - center, m - center)) for c, s, m in zip(counts, spreads, means)) / max(1, total)
    target = np.diag(np.diag(pooled) + 1e-3)
    factors, constants = [], []
    for label in (0, 1):
        if not counts[label]:
            means[label] = center
        share = max(shrinkage, (k + 1) / (k + 1 + counts[label]))
        factor = np.linalg.cholesky((1 - share) * spreads[label] + share * target)
        factors.append(factor)
        constants.append(float(np.log((counts[label] + 1e-9) / (total + 2e-9)) - np.log(np.diag(factor)).sum()))
    return Discriminant(means, factors, constants)


def quality(model: Discriminant, stats: Column) -> Column:
    """Score from 0 to 1 of a column of statistics."""
    held = model

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            x = np.array(values.tolist(), float).reshape(-1, len(NAMES))
            yield pd.Series(held.scores(x))

    return F.pandas_udf(score, "double")(stats)
