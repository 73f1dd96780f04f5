"""Every registered query of the reference's operators equals its SQL on the smallest tables."""

import duckdb
import pytest

from agentlake.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, D)
    want = con.sql(catalogue.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    left = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    right = sorted(repr([plain(r[k]) for k in order]) for r in want.fetchall())
    assert left == right
