import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of given texts, with ids from 0."""
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in zip(ids, texts)], SCHEMA)
    return make
