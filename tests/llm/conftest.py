import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id string, ld_id string"


def rows_of(texts):
    """Documents with nulls in other columns and with columns that clash with operators' names."""
    return [(i, t, None, None if i is None or i % 3 == 0 else f"s{i % 2}", None, None, "x", "y") for i, t in texts]


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7))) for _ in range(400)]
    return lambda n, seed: [random.Random(seed * 1000 + k).choice(vocabulary) for k in range(n)]
