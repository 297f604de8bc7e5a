import duckdb
import pytest

from lodestone import registry
from lodestone.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    return v.isoformat() if hasattr(v, "isoformat") else repr(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in found.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:  # no SQL can express it: the same rows again from other partitions
        again = registry.queries()[name](spark, SF).repartition(3)
        assert rows == sorted(tuple(norm(r[c]) for c in columns) for r in again.collect()) and rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in result.fetchall())
