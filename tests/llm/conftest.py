import random

import pytest

WORDS = "the of and a in tion ing er re on an ed th der die und que los les des idiot moron quick brown fox jumps over lazy dog".split()


@pytest.fixture(scope="session")
def docs(spark):
    """A small table with every odd case: null and empty texts, a null id, repeated rows and texts, a very long text,
    near copies, unusual characters, and extra columns whose names operators use themselves."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = text(120)
    words = base.split()
    near = " ".join(w if k != 60 else "changed" for k, w in enumerate(words))
    rows = [(k, text(rng.randint(1, 200)), ["en", "de", None][k % 3]) for k in range(30)]
    rows += [(30, None, "en"), (31, "", "en"), (32, " \n\t ", None), (33, base, "en"), (34, near, "en"), (35, base, "de"), (36, base, "en"), (36, base, "en")]
    rows += [(37, "ÄÖ ß İ ǅ don't 'tis <|endoftext|> 漢字 1234 a b \x1c x", "en"), (38, "word " * 40_000, "en"), (None, "no id here", "en"), (39, "i d i o t and 1d10t and idiooot", "en")]
    frame = spark.createDataFrame([(*r, 1, "r", 2.0, "x") for r in rows], "doc_id long, text string, lang string, row int, digest string, score double, key string")
    return frame.repartition(3)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
