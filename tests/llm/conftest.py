import random

import pytest

WORDS = "the of and house river stone quick green lamp paper cloud market seven north window garden bright iron letter song".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (f"{r.randrange(50)}" if r.random() < 0.4 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empties, copies, near copies, shared passages, a long text, odd bytes, repeated rows and ids."""
    base, passage = prose(1, 80), prose(2, 40)
    near = base.split()
    near[40] = "changed"
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "Two words"), (7, "two WORDS"),
        (8, base), (9, base), (10, " ".join(near)), (11, base.upper()),
        (12, prose(3, 30) + "\n" + passage + "\n" + prose(4, 30)), (13, passage + " end"), (14, prose(5, 20) + "  " + passage),
        (15, "a " * 200), (16, "é☃ " * 60 + passage), (17, "x" * 300), (18, "x" * 70), (19, prose(6, 60)),
        (20, prose(7, 20_000)), (20, prose(8, 25)), (19, prose(6, 60)), (None, base), (None, None), (21, "line\nline\n\nline two\r\nline"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names clash with what operators add."""
    rows = [(d, t, "en", "s", len(t or ""), 0.5, 1, "k") for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int, kept string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
