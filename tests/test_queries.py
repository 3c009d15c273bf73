"""Each registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from quarrylog.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for table in ("events", "documents"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    if name not in SQL:
        assert rows
        return
    table = duck.sql(SQL[name])
    assert sorted(table.columns) == names
    want = [tuple(r[table.columns.index(c)] for c in names) for r in table.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["rule", "severity", "message", "count", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
