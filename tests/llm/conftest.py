from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and with stone river light under garden music winter paper silver engine forest window candle market bridge harbor".split()


def sentence(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ed", "ing", str(rnd.randrange(40))]) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, sentence(1, 60), "en", "s1", 1), (2, sentence(1, 60), "en", "s2", 1), (2, sentence(1, 60), "en", "s2", 1), (3, None, None, None, None), (4, "", "de", "s1", 0), (5, "", "de", "s1", 0),
        (None, "no id here, but a text of some words to count", "en", "s1", 3), (6, "x", "en", "s1", 1), (7, "\n\n \t", "en", "s1", 1), (8, "a" * 200_000, "en", "s1", 1),
        (9, sentence(9, 30_000), "en", "s1", 1), (10, "🙂 漢字 " * 50, None, "s3", 1), (11, sentence(1, 58) + " changed end", "en", "s2", 1), (12, "... !!! ###", "en", "s2", 1), (12, None, "en", "s2", 1),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(["id", "txt", "key", "row", "score", "n_words", "shard", "weird name.x"])})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
