import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, fp string, sha string, label int, ids string, hash string, root bigint, key bigint"


def text(seed: int, words: int = 60) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghinorst") for _ in range(r.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Odd documents: null and empty texts and ids, copies, repeated rows, ties, a very long text."""
    long = " ".join(text(k, 500) for k in range(40))
    rows = [(1, text(1)), (2, text(1).upper()), (3, text(2)), (3, text(2)), (4, None), (5, ""), (6, " \n\t "), (None, text(1)), (None, None), (7, long), (8, long + " x"), (9, "Ünïcödé 日本語 \U0001f600\x00 a▁b"), (10, "a"), (10, "b"), (11, text(3)), (12, text(3) + "!")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(a, b, "en", "f", "s", 1, "i", "h", 5, 6) for a, b in corpus], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
