import random

import pytest

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, pos int, id string, component string"


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Copies, near copies, shared passages, repeats, edge cases, and columns whose names clash with internal ones."""
    r = random.Random(5)
    base, passage = sentence(r, 120).split(), sentence(r, 60)
    texts = [sentence(r, r.randint(1, 200)) for _ in range(30)]
    for _ in range(90):  # a large group of near copies
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    texts += [f"{sentence(r, 50)} {passage}\n{sentence(r, 5)}" for _ in range(20)]
    texts += [" ".join(base)] * 12 + ["a b c d " * 30, "x " * 500, "A B", "a b", "", " \t\n", None, None, "é" * 40, sentence(r, 9000)]
    rows = [(i, t, "en", None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 7}", 0, 1, "k", 2, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """A null identifier and a repeated row."""
    return spark.createDataFrame([(None, "t " * 30, None, None, None, 1, "k", 2, "x", "y"), (1, "t " * 30, None, None, None, 1, "k", 2, "x", "y"), (1, "t " * 30, None, None, None, 1, "k", 2, "x", "y"), (2, "", None, None, None, 1, "k", 2, "x", "y")], DOCS)
