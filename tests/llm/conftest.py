import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, kind string, `class` long, shard string, `row` int, `text_x.y` string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(["ka", "lo", "mi", "ter", "un", "vo", "sy"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]


@pytest.fixture(scope="session")
def texts(words):
    """Texts with copies, near copies, shared passages, short and long ones."""
    rng = random.Random(6)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [make(rng.randint(1, 200)) for _ in range(60)]
    passage = make(70)
    for i in range(12):
        out.append(make(20) + "\n" + passage + " " + make(15))
    base = make(120).split()
    for i in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append(" ".join(copy))
    out += [out[0]] * 5 + [out[1].upper()] + ["one two", "one  two", "ONE TWO", "a b c d", "a b c d e", "x"]
    out += [make(20_000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Every odd case: null ids, texts and sources, blanks, repeated rows, extra columns with clashing names."""
    rows = [(i * 3 - 40, t) for i, t in enumerate(texts)]
    rows += [(5000, None), (5001, ""), (5002, " \t\n "), (5003, "ß Ünï 日本語 é"), (5003, "ß Ünï 日本語 é"), (5003, "another text of the same id"), (None, texts[3]), (None, "no id at all here"), (None, None)]
    langs, sources = ["en", "de", None], ["a", "b", None, "c"]
    rows = [(i, t, langs[k % 3], sources[k % 4], 1, k, "k", k, "s", k, "z") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
