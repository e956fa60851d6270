"""Documents with everything that may be odd about them."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, component_id long, ids string, part int"


def rows():
    long = " ".join(f"palabra{k % 97} and the of" for k in range(20_000))
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, long), (5, "the same words in this text again"), (6, "the same words in this text again"), (7, "The SAME words in this text again"),
        (None, "a row without an id"), (8, "twice this id"), (8, "twice this id"), (9, "nul \0 inside, 你好 мир, <|endoftext|> ▁▁   x"), (10, "12 345 ... !!"), (11, "x"),
    ]
    return [(i, t, "en", "s", len(t or ""), "r", 0.5, 3, "i", 1) for i, t in texts]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture
def odd_rows():
    return [(r[0], r[1] or "") for r in rows()]


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
