"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, DIRECTORY)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        assert difference(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_only_expected_queries_lack_sql():
    own = {name for name in QUERIES if not re.fullmatch(r"op\d+_.*|pipeline", name)}
    assert own <= set(ORACLES)
