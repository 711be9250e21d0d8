"""Every plan against the same plan in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, places=6):
    return sorted(repr(tuple(round(float(v), places) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    shown = ", ".join(f'"{c}"' for c in columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(duck.sql(f"SELECT {shown} FROM ({catalog.ORACLE_SQL[name]}) t").fetchall())
