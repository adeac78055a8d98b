"""Registered queries against their SQL on the driver's tables, where these are there."""

import os

import duckdb
import pytest

from cairnstore.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns)) for r in cursor.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in sorted(columns)) for r in df.collect()) == want
