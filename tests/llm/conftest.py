import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _sentence(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghinorst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def _edit(rng, text):
    w = text.split(" ")
    for _ in range(max(1, len(w) // 25)):
        w[rng.randrange(len(w))] = "edited" + str(rng.randrange(99))
    return " ".join(w)


@pytest.fixture(scope="session")
def rows():
    """Null, empty, blank, tiny and long texts, copies, near copies, shared passages, periodic text, a repeated row."""
    rng = random.Random(5)
    passage = _sentence(rng, 130)
    base = _sentence(rng, 160)
    texts = [None, "", " \n", "a", "a b", "a  b", "A b", "x" * 1000, "x " * 300, "ab" * 700, "é" * 5, "日本語 の テキスト", "word", "the 1 of 2\nthe 3 of 4"]
    texts += [_sentence(rng, rng.randint(3, 220)) for _ in range(60)]
    texts += [_sentence(rng, 40) + " " + passage + " " + _sentence(rng, rng.randint(1, 60)) for _ in range(12)]
    texts += [base] * 4 + [_edit(rng, base) for _ in range(25)] + [base.replace(" ", "\n", 7)]
    texts += [passage[200:900], passage[:450] + passage[300:900], _sentence(rng, 9000)]
    texts += ["\n".join(["Header line of the page number %d here" % i, _sentence(rng, 20), "All rights reserved by the owner"]) for i in range(30)]
    rng.shuffle(texts)
    out = [(3 * i + 1, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[7]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
