"""Every named query against its SQL on whole small tables; the others must at least run and keep their schema."""

import pytest
from oracle import DATA, connect, same

from corpusforge.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, DATA)
    if name in oracle_sql():
        same(con, df, oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
