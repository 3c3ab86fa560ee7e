import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, line int, fp long, item_id int, score string, h int, recipe binary, start int, length int, key string, turn int, word string"


def rows_of(texts, ids=None):
    """Documents whose other columns have names that the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "s", None if t is None else len(t), "x", 1, 2, 3, "y", 4, b"z", 5, 6, None, 7, "w") for i, t in zip(ids, texts)]


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, ids=None: spark.createDataFrame(rows_of(texts, ids), SCHEMA)


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def edge_texts(vocabulary):
    """Null, empty, blank, one word, repeated, near, very long and odd texts."""
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, long = say(120), "\n".join(say(30) for _ in range(800))
    near = base.split()
    near[60] = "changed"
    return [None, "", " \n\t ", "one", "one", base, base, " ".join(near), base.upper(), base.replace(" ", "  "), long, long + "\nlast line of the text", say(40) + "\n" + base, "é中文 \U0001f600 naïve text <|endoftext|> \x1c x", say(300), say(300), "12 34 | 56", None]


@pytest.fixture(scope="session")
def edge_ids(edge_texts):
    ids = list(range(len(edge_texts)))
    ids[-1] = None
    return ids
