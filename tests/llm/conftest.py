from __future__ import annotations

import pytest

EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, kept boolean, score double, base string, n long"


@pytest.fixture(autouse=True)
def shipped(spark):
    from logloom.llm.shared import ship

    ship(spark)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
    texts = [
        (1, "one two three four five. six seven\nand a second line of words"),
        (2, "one two three four five. six seven\nand a second line of words"),
        (2, "one two three four five. six seven\nand a second line of words"),
        (3, None),
        (4, ""),
        (None, "a text without a number"),
        (None, None),
        (5, long),
        (6, long + " end"),
        (7, "  odd   spaces \t\n\n and   ünïcödé \U0001d11e 汉字 <s> </s> <|endoftext|> ▁ \\ "),
        (8, "x"),
        (9, "\n\n\n"),
    ]
    return [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else "s", None, "r", "k", None, 0.5, "b", k) for k, (i, t) in enumerate(texts)]


@pytest.fixture
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, EDGE_SCHEMA)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
