"""Every query with SQL gives the rows of its SQL; the others run."""

import oracle
import pytest

from spindrift.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in ORACLES:
        oracle.compare(spark, QUERIES[name], ORACLES[name], data)
    else:
        assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert sorted(tuple(r) for r in entry.entry(spark).collect()) == [(0, 1), (1, 6), (2, 21), (3, 19), (4, 1)]
    assert set(entry.oracle_sql()) <= set(entry.queries())
