import random

import pytest
from llmdata import DOCS, row


@pytest.fixture(scope="session")
def sentence():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñ") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def table(spark):
    return lambda rows: spark.createDataFrame(list(rows), DOCS)


@pytest.fixture(scope="session")
def odd_rows(sentence):
    """Nulls in every column, empty and white texts, a very long text, equal rows, equal ids, copies."""
    long = "\n".join(sentence(30) for _ in range(1500))
    copy = sentence(60)
    return [row(1, copy), row(2, copy), row(2, copy), row(3, None), row(4, ""), row(5, " \n\t "), row(6, long), (7, copy, *(None,) * 9), row(None, copy),
            row(None, None), row(8, "a" * 20_000), row(9, "line one\n" * 40), row(10, "ÀÉ $5 &| ünïcode 漢字 \U0001f600 x\x00y"), row(11, sentence(25) + "\n" + copy)]
