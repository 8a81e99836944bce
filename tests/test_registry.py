"""Every registered query against its oracle."""

import duckdb
import pytest

from check import TABLES, compare
from registry import QUERIES

from .conftest import SMALL


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, verdict = compare(spark, con, name, SMALL)
    assert verdict.startswith("ok"), verdict
