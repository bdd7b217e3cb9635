"""Every registered catalogue query gives the rows of its oracle."""

import pytest

from tests.compare import assert_same
from tidemark.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    if name in ORACLES:
        assert_same(df, ORACLES[name], tiny)
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
