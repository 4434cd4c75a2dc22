import random

import pytest


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows, with columns that operators must not mind."""
    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", 1.0, "x") for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, score double, n_words string")

    return build


@pytest.fixture
def prose():
    """Invented sentences; other letters for other seeds."""
    def build(seed, words=40, letters="abcdefgh"):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(words))

    return build

