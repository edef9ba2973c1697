from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double"

#: Nulls in any column, empty and very long texts, ties and repeated rows, and columns whose names operators also return.
ODD = [
    (1, None, None, None, None, None, None),
    (2, "", "en", "a", 0, True, 1.0),
    (3, " \n\t\n ", "en", "a", 5, False, None),
    (4, "one", "en", None, 3, None, 0.5),
    (5, "one two", "en", "a", 7, None, 0.5),
    (5, "one two", "en", "a", 7, None, 0.5),
    (None, "a text without an id. " * 20, "en", "a", 440, None, None),
    (7, "same line here\nand another line\nthe third line of it\n" * 3, "en", "b", 159, None, None),
    (8, "same line here\nand another line\nthe third line of it\nend", "en", "b", 57, None, None),
    (9, " ".join(f"w{i}" for i in range(60_000)), "en", "b", 350_000, None, None),
    (10, "x" * 300_000, "en", "b", 300_000, None, None),
    (11, "Ünïcödé 文字 \U0001f600 it's\x1c\xa0done.", "xx", "c", 25, None, None),
    (12, "Ünïcödé 文字 \U0001f600 it's\x1c\xa0done.", "xx", "c", 25, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, None if i == 4 else i % 2, 0) for i in range(1, 13)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
