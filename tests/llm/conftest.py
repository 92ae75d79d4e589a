import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="session")
def corpus(words):
    """(doc_id, text): distinct texts, exact copies, near copies with edits on both sides, shared passages of all lengths, and odd ones."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(30, 400)) for _ in range(40)]
    base = prose(500)
    near = []
    for _ in range(25):
        w = base.split(" ")
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        near.append(" ".join(w))
    passages = [prose(n) for n in (49, 50, 51, 60, 70, 90, 150)]
    shared = [prose(rng.randint(0, 80)) + " " + rng.choice(passages) + rng.choice([" ", "\n"]) + prose(rng.randint(0, 80)) for _ in range(60)]
    odd = ["", None, " \n\t ", "a", "Aa aA\naa AA", "x " * 700, "ab" * 900, "\x00" * 900, "é" * 801, prose(50) + "\n" + prose(3), "line one\nline one\nline one", base, base, texts[0], texts[0].upper()]
    every = texts + near + shared + odd
    rng.shuffle(every)
    return list(enumerate(every))


@pytest.fixture
def documents(spark, corpus):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in corpus], DOCUMENTS).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
