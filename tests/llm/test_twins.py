"""The operators with SQL twins give the twins' rows on whole tables."""

import duckdb
import pytest

from odflow.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        path = f"{DIR}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, DIR)
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(r) for r in got.select(names).collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
