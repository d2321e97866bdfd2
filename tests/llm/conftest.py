import random

import pytest

WORDS = "alpha beta gamma delta the of and river stone light über straße été niño casa verde".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with exact copies, near copies, shared passages, repeats inside, odd and empty texts."""
    rng = random.Random(5)
    docs = [prose(rng, rng.randint(1, 400)) for _ in range(40)]
    passage = prose(rng, 90)
    docs += [prose(rng, 30) + " " + passage + " " + prose(rng, 20) for _ in range(6)]
    docs += [docs[3]] * 5
    near = prose(rng, 300).split()
    for k in range(6):
        copy = list(near)
        copy[10 + 40 * k] = "changed"
        docs.append(" ".join(copy))
    line = prose(rng, 60)
    docs += [line + "\n" + line + "\n" + line, "", None, " \t\n", "one", "x" * 700, "ab" * 400, "  ÄÖ  ", "z" * 199, "z" * 200, "\x00" * 450, passage, "1 2 3", "THE OF and"]
    return list(enumerate(docs))


EXTRA = "doc_id long, text string, lang string, score double, uid long, spans string"


@pytest.fixture(scope="session")
def frame(spark, corpus):
    """The corpus with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 0.5, 1, "s") for i, t in corpus], EXTRA)


@pytest.fixture(scope="session")
def odd(spark, corpus):
    """Null and repeated ids, repeated rows."""
    rows = [(None, corpus[41][1]), (None, corpus[42][1]), (7, corpus[43][1]), (7, corpus[43][1]), (7, corpus[44][1]), (-3, corpus[45][1]), (9, None), (9, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="session")
def spark():
    from palimpsest.session import local_session

    yield local_session(cores="4", partitions=4, memory="4g")
