import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of (doc_id, text), with source by id; clash adds columns that have the names of results and inner columns."""

    def make(rows, clash=False):
        full = [(i, t, "en", None if i is None else f"src{i % 3}", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            for name in ("score", "kept", "rule", "words", "word", "n", "c", "key", "copy", "n_copies", "cell", "rep", "digest", "bucket", "quality", "label", "n_words", "row", "posts"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def words():
    """Reproducible prose of n words."""

    def make(n, seed=0):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_rows(words):
    """Null ids and texts, empty, blank, short and very long texts, repeated rows."""
    return [(1, words(80, 1)), (1, words(80, 1)), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, "one"), (6, "Two words"), (7, words(30_000, 7)), (8, "É\u00a0ß x\x00y \U0001f600"), (None, "no id here"), (None, None), (9, "a b c " * 400)]
