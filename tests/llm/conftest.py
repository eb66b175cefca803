import random

import pytest
from pyspark.sql import types as T

#: Extra columns whose names clash with those that the operators use inside.
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, h int, digest string, rep int, slot string, bucket int, tag string, score string, _id string, _sha string, _copy int, copies int"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of tables of documents from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None, 1, "x", 2, "y", 3, "z", "w", "v", "u", 4, 5) for i, t in rows], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "délta", "epsilon", "zeta,", "eta.", "THETA", "iota!!", "漢字"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    near = [rng.choice(words) + str(i) for i in range(60)]
    return [
        (0, " ".join(near)), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, " ".join(near[:-1] + ["other"])), (6, "  ".join(near)), (7, "x" * 5_000), (None, "no id here at all"), (8, "tie"), (9, "tie"),
        (10, "repeated row of some words"), (10, "repeated row of some words"), (11, long[: len(long) // 2]), (12, "a"), (13, None),
    ]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOCUMENTS))
