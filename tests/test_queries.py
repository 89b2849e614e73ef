import os

import duckdb
import pandas as pd
import pytest

from tabsift.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(frame):
    def value(v):
        if pd.isna(v):
            return ""
        return str(round(float(v), 6) if isinstance(v, float) else v)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(value, r)) for r in frame.itertuples(index=False))


def number(rows):
    return [tuple(c.removesuffix(".0") for c in r) for r in rows]


@pytest.mark.parametrize("name", list(SQL))
def test_sql_gives_the_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DIR).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert number(plain(ours)) == number(plain(theirs))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_others_run(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
