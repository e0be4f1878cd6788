from __future__ import annotations

import pytest
from pyspark.sql import types as T

from depvital.llm.common import find_package

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # names that the operators use themselves
        *[T.StructField(c, T.StringType()) for c in ("kept", "row", "digest", "n_lines", "score", "key", "bytes", "shard", "ids", "tree", "fp", "a.b")],
    ]
)


@pytest.fixture(autouse=True)
def importable(spark):
    find_package(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Frame of (doc_id, text, lang, source) rows with extra columns of clashing names."""

    def make(rows):
        full = [(*row, *[None] * (4 - len(row)), *["x"] * (len(DOCUMENTS) - 4)) for row in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(3)

    return make


LONG = "word and other words, repeated " * 8000
AWKWARD = [
    (1, "Same text", "en", "a"),
    (2, "Same text", "en", "a"),
    (2, "Same text", "en", "a"),
    (9, "Same text", None, None),
    (3, None, "en", "a"),
    (4, "", None, "b"),
    (5, " \t\r\n ", "de", None),
    (6, LONG, "en", "b"),
    (7, LONG + "end", "en", "b"),
    (None, "Same text", "fr", "b"),
    (None, None, None, None),
    (8, "Ünïcödé 中文 🙂 text\nwith lines\r\nand \x0b blanks", "fr", "c"),
]
