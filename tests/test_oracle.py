"""Every registered query beside its SQL on DuckDB, on the smallest tables."""

import os

import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from check_queries import compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="test tables are not here")
QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMOKE_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMOKE_DIR)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 18 and {r.tumor_category for r in rows} == {"small", "medium", "large"}


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
