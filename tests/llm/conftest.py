import random

import pytest

DOCS = "doc_id long, text string, lang string, block int, n_words int, id string, row string, kept string"


def make_words(rng, n):
    common = "the of and to in a is that it for on was as with by be this are or an".split()
    parts = "an en er in on re th st ti nd ha ed or is ea at he ou".split()
    return [rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices(parts, k=rng.randint(2, 4)))
            for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """(id, text): random prose, copies, near copies, shared passages, odd and empty texts; ids are distinct."""
    rng = random.Random(5)
    out = [" ".join(make_words(rng, rng.randint(30, 200))) for _ in range(60)]
    passage = " ".join(make_words(rng, 70))
    out += [out[3]] * 5 + [out[7]] * 2
    for base in (10, 11, 12):
        for _ in range(4):                                  # near copies: one word in sixty differs
            w = out[base].split()
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w) + " " + " ".join(w[:3]))
    out += [f"{' '.join(make_words(rng, 15))} {passage}\n{' '.join(make_words(rng, 9))}" for _ in range(8)]
    out += [None, "", "   \n\t ", "one", "two words", "1234 !!! 5678", "word " * 300, "x" * 30_000,
            "élève 你好 привет " * 8, "<|endoftext|> as text", " ".join(make_words(rng, 20_000))]
    return [(i * 7 + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with columns whose names the operators also use inside."""
    rows = [(i, t, "en" if i % 3 else None, 1, 2, "x", "y", "z") for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
