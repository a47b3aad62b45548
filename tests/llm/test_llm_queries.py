"""Problems that SQL can express, compared with DuckDB on the smallest tables; the others run on them."""

from __future__ import annotations

from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry
from axiomill.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    names, rows = oracle.spark_rows(entry.queries()[name](spark, DATA))
    sql = queries.ORACLES.get(name)
    if sql is None:
        assert names and rows
    else:
        assert (names, rows) == oracle.duck_rows(DATA, sql)
