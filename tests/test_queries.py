"""Every registered query of the engine against its SQL equivalent."""

from __future__ import annotations

import pytest

from webstrata import queries

from .conftest import rows_of


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
