import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text, ...) to a table of documents."""

    def make(rows, partitions=3):
        full = [(r + (None,) * 5)[:5] for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions) if full else spark.createDataFrame([], DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Invented sentences: (seed, words) -> text."""

    def make(seed, words):
        rng = random.Random(seed)
        stems = ["the", "of", "and", "to", "in", "river", "stone", "walks", "evening", "quiet", "market", "carries", "letter", "garden", "window"]
        return " ".join(rng.choice(stems) + rng.choice(["", "", "", ",", "s"]) for _ in range(words)).capitalize() + "."

    return make


#: nulls, empties, white space, a very long text, repeats
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "b c"), (5, "word " * 40_000), (6, "naïve 日本 😀 ﬁ <s> <|endoftext|>"), (7, "x" * 30_000)]


@pytest.fixture(scope="session")
def edges():
    return list(EDGES)
