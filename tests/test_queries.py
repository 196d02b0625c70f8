"""Every registered query with SQL against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from geoquarry.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_rows_as_sql(spark, duck, name):
    q = QUERIES[name]
    df = q.run(spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    res = duck.execute(q.sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(str([plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
