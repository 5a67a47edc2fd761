import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, id string, node string, row string"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["an", "the", "ou", "ing", "st", "re", "é", "er"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def hard_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows and columns whose names clash with working columns."""
    r = random.Random(3)
    long = "\n".join(words(r, 40) + "." for _ in range(900))
    texts = [None, "", "", " ", "\n\n", "x", long, long, "The same line here.\nThe same line here.\nAnd another line."]
    texts += [words(r, r.randrange(3, 120)) + ".\n" + words(r, 30) for _ in range(60)]
    texts += texts[20:26]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None, "s", "q", "i", "n", "r") for i, t in enumerate(texts)]
    return [*rows, rows[30], rows[30], (None, "text without an id here", "de", "src0", 3, None, None, None, None, None)]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
