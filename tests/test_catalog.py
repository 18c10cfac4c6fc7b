"""Every registered query of the library against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from sparkloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def same(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.8g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:19]
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    got = sorted(str([same(r[c]) for c in cols]) for r in df.collect())
    want = sorted(str([same(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert os.path.exists(__spark_entry__.__file__)
