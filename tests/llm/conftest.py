import random

import pytest


@pytest.fixture
def prose():
    """Invented words: prose(seed, n)."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(("ra", "to", "mi", "len", "so", "ka", "dur", "ven")) for _ in range(rng.randrange(1, 4))) for _ in range(n))

    return make


#: Nulls, empty and odd texts, repeated rows, columns whose names the operators use inside.
EDGES = [(1, "", "a"), (2, None, "a"), (3, "...", None), (4, "\n\n", None), (5, "x", "b"), (5, "x", "b"), (None, "no id here", "a"), (None, None, None), (7, "é ñ 漢字 \U0001f600 ▁", "b"), (8, "a" * 200_000, "b"), (9, "word " * 5000, "a")]
EDGE_SCHEMA = "doc_id long, text string, source string"


@pytest.fixture
def edges(rows):
    from pyspark.sql import functions as F

    base = rows(EDGES, EDGE_SCHEMA)
    for name in ("lang", "n_chars", "score", "spans", "label", "node", "digest", "items", "held_out", "n_words", "band", "page", "a.b"):
        base = base.withColumn(name, F.lit(None).cast("string") if name == "lang" else F.lit(7))
    return base
