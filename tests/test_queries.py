"""Every registered query of the engine against its SQL, run by DuckDB over the same files."""

import math

import duckdb
import pytest

from corvine import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"
TYPES = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    kinds = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {catalog.oracle_sql()[name]}").fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == kinds
    cur = duck.execute(catalog.oracle_sql()[name])
    order = sorted(names)
    got = sorted(((tuple(plain(r[c]) for c in order)) for r in df.collect()), key=repr)
    want = sorted(((tuple(plain(r[names.index(c)]) for c in order)) for r in cur.fetchall()), key=repr)
    assert got and got == want


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n not in catalog.oracle_sql()])
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
