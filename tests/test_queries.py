"""Every query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from workload.check import connect, difference, types_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, sql, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = [tuple(r) for r in frame.select(columns).collect()]
    assert rows
    if name in entry.oracle_sql():
        relation = sql.sql(entry.oracle_sql()[name])
        assert types_of(frame, relation) is None
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert difference(columns, rows, relation.project(quoted).fetchall()) is None


def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0
