import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "k1 string, k2 string, row int, name string, n int, packed string"
)


def make_rows(seed=3):
    """Texts with copies, near copies, shared passages, odd white space, ties and nulls."""
    rng = random.Random(seed)
    vocabulary = [
        "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6))) for _ in range(400)
    ]

    def words(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    passage = words(60)
    texts = [" ".join(words(rng.randint(1, 160))) for _ in range(40)]
    base = words(150)
    for _ in range(12):  # near copies of different distance
        copy = base.copy()
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    for _ in range(6):
        texts.append(" ".join(words(20) + passage + words(20)))
    texts += [texts[3]] * 4 + [texts[5].replace(" ", " \t\n"), texts[5].upper()]
    texts += ["", None, " ", "\n\t", "one", "One", "a b c d", "a b  c d", "x " * 300, "x " * 90]
    texts += [" ".join(words(4000)), "ab" * 30000, "a b  c", "b " + " ".join(passage)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, texts[5]), (5, texts[5]), (7, "another text under a used id"), (None, texts[3]),
             (None, None), (-4, texts[9]), (1 << 40, texts[0])]
    return [
        (i, t, "en" if n % 3 else None, f"s{n % 4}" if n % 5 else None, None if t is None else len(t),
         "x", "y", n, "z", 1, None)
        for n, (i, t) in enumerate(rows)
    ]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
