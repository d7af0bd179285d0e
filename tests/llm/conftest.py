import random

import pytest

WORDS = [a + b for a in "ba ko mi tu re so la ne di fu ga pe".split() for b in "lan rit mos ek ua thi nor sel vip dra".split()]


def prose(seed, n, words=WORDS):
    rng = random.Random(seed)
    out, line = [], []
    for _ in range(n):
        line.append(rng.choice(words))
        if rng.random() < 0.08:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join([*out, " ".join(line)])


ODD = "doc_id long, text string, lang string, source string, n_chars long, id long, a string, b string, word int, band long, score double, keep boolean, toxic boolean, `__lost` int, `odd name` string"


def odd_rows():
    """Null, empty, blank and very long texts, repeated rows, shared and null ids, characters of all sizes."""
    texts = [
        (1, None),
        (2, ""),
        (3, " \t\n \n"),
        (4, "a"),
        (5, "one two"),
        (6, prose(1, 40_000, [w + "q" for w in WORDS])),
        (7, "日本語 " * 50 + "🙂🙂 ﬁne İstanbul"),
        (8, prose(2, 120)),
        (8, prose(2, 120)),
        (9, prose(2, 120)),
        (None, prose(2, 120)),
        (None, None),
        (10, "x" * 50_000),
        (11, "\n\n\nsame line here\nsame line here\n\n"),
        (12, "And And And " * 100),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), 77, "x", "y", 3, 4, 0.5, True, False, 1, "z") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)
