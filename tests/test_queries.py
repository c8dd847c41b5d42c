"""Every registered survey query with an SQL twin gives the twin's rows."""

import math

import duckdb
import pytest

from odflow.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v
    return sorted(([value(r[i]) for i in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, db, name):
    got = QUERIES[name](spark, DIR)
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_others_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
