"""Every query that has SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

from millrace.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(row):
    return tuple(f"{x:.9g}" if isinstance(x, float) and math.isfinite(x) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    quoted = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"select {quoted} from ({SQL[name]}\n)").fetchall()
    assert sorted(map(plain, df.collect())) == sorted(map(plain, want))


def test_every_query_without_sql_runs(spark):
    for name in sorted(QUERIES.keys() - SQL.keys()):
        assert QUERIES[name](spark, SF).count() > 0, name
