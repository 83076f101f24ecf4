"""Every registered query against its SQL on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from skyfold.plans.catalog import ORACLES, QUERIES


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, int):
            return repr(float(v)) if abs(v) < 2**53 else str(v)
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return str(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, key):
    df = QUERIES[key](spark, sf)
    cur = duck.execute(ORACLES[key])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical(df.columns, df.collect()) == canonical(cols, cur.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
