import random

import pytest

CLASHES = ["gone", "g1", "r1", "r2", "m1", "copies", "__gone", "__r1", "__row", "__b", "at", "part", "rank", "k1"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, piece string, kept string, " + ", ".join(f"{c} string" for c in CLASHES)


def words(rng, n, size=400):
    return " ".join("w" + str(min(rng.randrange(size), rng.randrange(size))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared lines, nulls, empties, a long text, ties, clashing column names."""
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    shared = "this very common line stands in many documents of the corpus"
    out = []
    for i, t in enumerate(texts):
        w = t.split()
        out.append(t if i % 3 else t + "\n" + shared.upper() + " \n" + words(rng, 5) + "\n" + shared)
        if i % 5 == 0:
            out.append(out[-1])
        if i % 4 == 0 and len(w) > 50:
            out.append(" ".join(w[:3] + ["new"] + w[4:]))
    out += [None, "", " \n\t ", "one", "one", "one two", words(rng, 9000), "Ünïcode ÉÉ word\x0bbreak", "<|endoftext|> it's"]
    docs = [(i, t, "en" if i % 2 else None, f"s{i % 4}" if i % 7 else None, len(t or ""), "x", "y", None, *CLASHES) for i, t in enumerate(out)]
    return docs + [docs[5], (None, "no id here", None, "s1", 10, "x", "y", None, *CLASHES)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
