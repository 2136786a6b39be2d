"""Every registered stream query against its SQL."""

import pytest

from eventflow.plans.queries import oracle_sql, queries
from tests.conftest import canonical


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, sf, duck, name):
    got = queries()[name](spark, sf).toPandas()
    assert len(got.columns)
    if name in oracle_sql():
        want = duck.sql(oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
