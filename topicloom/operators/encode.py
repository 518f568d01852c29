"""Text to vectors. The encoder is any function from a list of texts to a matrix."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.constants import EMBEDDING_DIM
from topicloom.functions.columns import blank_if_null


def hashing_encoder(dim: int = EMBEDDING_DIM):
    """Factory of the default encoder: signed feature hashing of words, scaled to unit length.

    A word adds +1 or -1 to one position; both come from the md5 of its lower-case form, so
    any engine can repeat the result. Empty text gives the zero vector.
    """

    def load():
        import hashlib

        import numpy as np

        seen: dict[str, tuple[int, int]] = {}

        def place(word):
            digest = hashlib.md5(word.encode("utf-8")).hexdigest()
            if len(seen) > 500_000:
                seen.clear()
            seen[word] = hit = (int(digest[:8], 16) % dim, 1 if int(digest[8], 16) % 2 == 0 else -1)
            return hit

        def encode(texts):
            out = np.zeros((len(texts), dim), dtype=np.float64)
            for i, text in enumerate(texts):
                hits = [seen.get(w) or place(w) for w in text.lower().split()]
                if hits:
                    at, sign = zip(*hits)
                    out[i] = np.bincount(at, weights=sign, minlength=dim)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms == 0, 1.0, norms)

        return encode

    return load


def embed(df: DataFrame, text_col: str, encoder=None, dim: int = EMBEDDING_DIM, batch: int = 64) -> DataFrame:
    """Add ``embedding array<float>`` to every row.

    ``encoder`` is a factory: it is called once per Python worker, where it may load a model,
    and returns the function from texts to an (n, dim) matrix. Only the text column crosses
    to Python; there is no shuffle.
    """
    load = encoder or hashing_encoder(dim)

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            values = texts.tolist()
            rows = []
            for start in range(0, len(values), batch):
                rows.extend(encode(values[start:start + batch]).astype("float32"))
            yield pd.Series(rows)

    # Marked as not deterministic, so that Spark computes each vector once and no filter copies the call.
    to_vector = F.pandas_udf(vectors, "array<float>").asNondeterministic()
    return df.withColumn("embedding", to_vector(blank_if_null(text_col)))
