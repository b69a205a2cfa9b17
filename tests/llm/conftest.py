from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from usagelens.llm.common import prepared

# Columns that clash with names the operators use inside.
EXTRA = ["fp", "score", "recipe", "shard", "id", "_block", "node", "ids", "row", "part"]
ROWS = [
    (None, "a b c d"), (None, None), (1, None), (2, ""), (2, ""), (3, " \t\n "), (4, "word and more " * 4000), (5, "x" * 70_000),
    (6, "same text here as there"), (7, "same  text\there as there"), (7, "same text here as there"), (8, "日本語 🙂 <|endoftext|> x"),
    (9, "same text here as there"), (10, "One two three four five six seven eight nine ten eleven twelve"), (11, "A b İ ΣΣ é"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def odd(llm):
    """Nulls, empty and long texts, repeated rows and clashing columns."""
    docs = llm.createDataFrame([(i, t, None, None, None) for i, t in ROWS], SCHEMA)
    return docs.select("*", *[F.lit("clash").alias(c) for c in EXTRA]).repartition(3).cache()


@pytest.fixture(scope="session")
def none(llm):
    return llm.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(llm):
    """Documents of the smallest tables, as (doc_id, text)."""
    docs = llm.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs, {r["doc_id"]: r["text"] for r in docs.collect()}
