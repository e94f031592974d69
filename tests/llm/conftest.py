import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Invented texts with copies, near copies, shared passages, empty, null, short and long ones, and repeated rows."""
    rng = random.Random(5)
    texts = [words(rng, rng.randrange(20, 160), 5000) for _ in range(30)]
    passage = words(rng, 60, 5000)
    for i in (0, 1, 2, 3):
        texts[i] = texts[i] + " " + passage + "\n" + words(rng, 10, 5000)
    texts += [texts[5], texts[5], texts[6]]
    near = texts[7].split()
    near[3] = "changed"
    texts.append(" ".join(near))
    near = list(near)
    near[-2] = "altered"
    texts.append(" ".join(near))
    texts += ["a b c d " * 60, "one", "one", "", "", None, None, "   \n\t ", "é🎉 " * 90, "x" * 700, words(rng, 3000, 5000), passage]
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[8], (None, texts[9], "en", None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same documents with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(1).alias(c) for c in ("tid", "key", "copies", "row", "cover", "base", "words", "tok", "root", "band", "place", "name", "level", "items")))
