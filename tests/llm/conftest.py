import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """documents(list of texts or (id, text, source)) as a DataFrame."""

    def make(rows):
        rows = [(i, t, "src0") if not isinstance(t, tuple) else t for i, t in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)

    return make


@pytest.fixture
def prose():
    """prose(n): n words, the same at every run."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)] + ["été", "naïve", "straße", "ñandú", "a"]
    return lambda n: [rng.choice(vocabulary) for _ in range(n)]
