"""Every query of the catalog against its SQL in DuckDB on the small tables."""

import os

import duckdb
import pytest

from quern import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("part", "events", "documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _key(rows, columns):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in (r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLE_SQL[name])
    columns = sorted(x[0] for x in found.description)
    names = [x[0] for x in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    assert sorted(got.columns) == columns
    assert _key([r.asDict() for r in got.collect()], columns) == _key(want, columns)
