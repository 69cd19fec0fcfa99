"""Every registered query of the case graph against its SQL, at the smallest scale."""

import duckdb
import pytest

from tessera.plans import composites as more
from tessera.plans import queries as Q
from tessera.plans import workflows as flows

assert more and flows

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, small, db, name):
    df = Q.QUERIES[name](spark, small)
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name in Q.ORACLE_SQL:
        cur = db.execute(Q.ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(repr(r) for r in cur.fetchall())
        assert sorted(repr(tuple(r[c] for c in names)) for r in rows) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
