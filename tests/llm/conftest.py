import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, part int, row string"
WORDS = "alpha beta gamma delta river stone cloud amber north quiet seven eleven paper house garden".split()


def doc(i, text, source="s1"):
    """A row with columns whose names clash with those that operators use."""
    return (i, text, "en", source, len(text or ""), 1, 2, "x")


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): null, empty, blank and very long texts, copies, near copies, repeated rows, a null doc_id."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))
    base = say(60)
    near = base.split()
    near[30] = "changed"
    rows = [(1, base), (2, base.upper()), (3, " ".join(near)), (4, say(60)), (5, None), (6, ""), (7, " \n\t "), (8, "One two"), (9, "one  TWO"), (10, say(5)), (11, "日本語 naïve Straße ΣΑΣ"), (12, say(3000)), (None, say(9)), (10, say(7)), (4, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([doc(i, t, None if i == 8 else f"s{(i or 0) % 3}") for i, t in texts] + [doc(1, texts[0][1], "s1")], SCHEMA)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
