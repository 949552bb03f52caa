"""Every query against its SQL at sf0.001, values and kinds of columns."""

import duckdb
import pytest

import __spark_entry__ as entry
from textlab import queries as core

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def tidy(rows):
    return sorted((tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = tidy(map(tuple, df.select(*columns).collect()))
    if name not in core.ORACLES:
        assert rows
        return
    found = con.sql(core.ORACLES[name])
    assert dict(zip(found.columns, map(str, found.types), strict=True)) == {c: KINDS[t] for c, t in df.dtypes}
    assert rows == tidy(con.sql(f"SELECT {', '.join(columns)} FROM ({core.ORACLES[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
