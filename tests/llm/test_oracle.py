"""The corpus operators that SQL can say against that SQL, on the small tables."""

import math
import os

import duckdb
import pytest

from lorespark.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    x = QUERIES[name](spark, DATA)
    columns = sorted(x.columns)
    r = duck.sql(ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in x.collect())
    assert got and got == sorted(repr(tuple(plain(row[k]) for k in at)) for row in r.fetchall())
