"""The SQL of the operators against their rows: on a small corpus with nulls and repeats, and on the smallest tables."""

import duckdb
import pyarrow as pa
import pyarrow.parquet
import pytest

from tessera.llm import queries
from tessera.llm.oracles import ORACLE_SQL

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    PASSAGE + " one", "two\n" + PASSAGE, "lead " + PASSAGE + " tail of é words", PASSAGE + " one", "ab " * 40, "x" * 120, "", None, " \t\n", "Two words",
    "a b c d e f g h i j k l\na b c d e f g h i j k l\n#1 <x>", " ".join(f"Q{i}" for i in range(300)) + " " + PASSAGE + " mid " + PASSAGE,
]


def same(spark, con, name, at):
    got = queries.QUERIES[name](spark, at)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    want = con.sql(f"SELECT {columns} FROM ({ORACLE_SQL[name]}) t").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(map(repr, want))


def views(at):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("small"))
    items = [(1, "W5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (2, "two words"), (3, None), (10, "w20 w21"), (4, "never seen")]
    for name, key, rows in (("documents", "doc_id", list(enumerate(TEXTS))), ("benchmark", "item_id", items)):
        pa.parquet.write_table(pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}), f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_small_corpus(spark, small, name):
    same(spark, views(small), name, small)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_smallest_tables(spark, name):
    same(spark, views(SF), name, SF)
