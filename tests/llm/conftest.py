import random

import pytest

SCHEMA = "doc_id long, text string, lang string, keys string, key string, n long, others string, lines string, text_ string"


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named as operators name theirs."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "Gamma,", "x1"]) for _ in range(40_000))
    texts = [
        (1, "a b c d e f g h i j k l m n"), (2, None), (3, ""), (4, " \n\t \n"), (5, long), (6, "a b c d e f g h i j k l m n"),
        (6, "a b c d e f g h i j k l m n"), (6, "another text of the same id"), (None, "a b c d e f g h i j k l m n"), (None, None),
        (7, "one"), (8, "x" * 30_000), (9, "l1\nl2\nl3\nl4\nl5\nl6"), (10, "l1\nl2\nl3\nl4\nl5\nl6"), (11, "ünï ßtraße 日本 🙂 'tis"),
    ]
    return spark.createDataFrame([(i, t, None, "k", "k", None, "o", "l", "t") for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
