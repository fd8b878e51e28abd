"""Every registered telemetry query against its SQL in DuckDB."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from cyclespark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert compare(df, duck, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
