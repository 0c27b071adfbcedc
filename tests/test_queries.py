"""Every registered query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from frametally.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float) and v != v:
        return "null"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object).map(plain)
    return list(df.columns), sorted(map(tuple, df.to_numpy()))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = rows(QUERIES[name](spark, sf).toPandas())
    assert got[0]
    if name in ORACLE_SQL:
        assert got == rows(duck.execute(ORACLE_SQL[name]).df())
