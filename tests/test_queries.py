"""Every query with SQL is compared with DuckDB on the smallest tables."""

from __future__ import annotations

import re
from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
# The problems' queries are compared in tests/llm.
CORE = sorted(n for n in entry.queries() if not re.match(r"p\d+_", n))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    names, rows = oracle.spark_rows(entry.queries()[name](spark, DATA))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert names
    else:
        assert (names, rows) == oracle.duck_rows(DATA, sql)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
