import duckdb
import pytest

from wardcraft.plans.oracles import ORACLE_SQL
from wardcraft.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(small):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return db


def _plain(rows):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted([tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in rows], key=key)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_duckdb(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = _plain([tuple(r[c] for c in want.columns) for r in df.collect()])
    assert got == _plain(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
