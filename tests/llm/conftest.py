"""Rows that try every edge: nulls anywhere, empty and blank texts, repeats, ties, a long text, clashing names."""

import random

import pytest

EXTRA = "n long, tok string, score double, host string, part int, row long, block string, k1 long, size int, key string, file string, __row long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["the", "of", "and", "idiot", *["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 7))) for _ in range(400)]]
    return "".join(r.choice(words) + r.choice(["  ", "\n", ". ", " ", " ", " ", " "]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    base, long = prose(1, 120), prose(2, 30_000)
    texts = [(1, base), (2, None), (3, ""), (3, ""), (None, prose(3, 40)), (None, None), (4, " \n\t "), (5, long), (6, long), (7, base),
             (7, prose(4, 70)), (8, base.upper()), (9, base + " one more"), (10, "short text"), (11, "short  text"), (12, "Short\ttext"), (13, "é"),
             (14, "x" * 5000), (15, prose(5, 90)), (16, prose(5, 90).replace("the", "that", 1)), (1, base), (17, "\x00 odd \U0001f600 <|endoftext|> text")]
    return [(d, t, None if i % 5 == 4 else "en", None if i % 4 == 3 else f"s{i % 3}", None if t is None else len(t)) for i, (d, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    fill = (1, "t", 0.5, "h", 1, 2, "b", 3, 4, "k", "f", 5)
    return spark.createDataFrame([r + fill for r in edge_rows], f"{SCHEMA}, {EXTRA}").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], f"{SCHEMA}, {EXTRA}")
