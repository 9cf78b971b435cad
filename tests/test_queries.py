"""Every registered query against its SQL on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from tallyrod.queries import FLAGSHIP, ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        p = f"{DIR}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def same(spark, duck, name, query, sql):
    df = query(spark, DIR)
    cols = sorted(df.columns)
    mine = sorted(repr([plain(v) for v in r]) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == cols, name
    other = sorted(repr([plain(x[names.index(c)]) for c in cols]) for x in r.fetchall())
    assert mine == other, name


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    same(spark, duck, name, QUERIES[name], ORACLE[name])


def test_names():
    assert set(QUERIES) == set(ORACLE) and FLAGSHIP in QUERIES


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
