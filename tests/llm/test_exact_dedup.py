import hashlib
import re

import duckdb
import numpy as np
import pytest

from millrace.llm import binary_fuse
from millrace.llm.exact_dedup import SQL, Snapshot, classes, digests, drop_copies, exact_dedup, query


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((i, t or ""))
    out = []
    for norm, g in groups.items():
        keep = min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0]))[0]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i, _ in g]
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 500, 20_000])
def test_filter_has_no_false_negative(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n).astype(np.uint64)
    blob = binary_fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert binary_fuse.maybe_contains(blob, keys).all()
    assert binary_fuse.maybe_contains(blob, rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.001


def test_cases(spark):
    a = [(1, "a b"), (2, "ab "), (3, None), (None, ""), (5, "x" * 50_000), (1, "a b"), (None, "q"), (None, "q")]
    b = [(7, "a\nb\t "), (8, "x" * 50_000 + "\n"), (9, "new"), (10, "new"), (11, " "), (12, "é"), (13, "é")]
    schema = "doc_id long, text string"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    extra = [f"{i} as {c}" for i, c in enumerate(("sha", "n", "best", "keep_id", "shard"))]
    for x, y, rows in ((left, right, a + b), (left.limit(0), right, b), (left, right.limit(0), a), (left.limit(0), right.limit(0), [])):
        got = exact_dedup(x.selectExpr("*", *extra), y)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "tag", "stays"]
        assert sorted(map(tuple, got.drop("tag", "stays").collect()), key=str) == brute(rows)


def test_drop_copies(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (1, "ab", "t"), (2, "a b", "u"), (None, None, "v"), (None, "", "w"), (3, "c", None), (1, "d", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, drop_copies(df).collect()), key=str)
    assert [g for g in got if g[0] is not None] == [(1, "a b", "s"), (1, "d", "s"), (3, "c", None)]
    assert len([g for g in got if g[0] is None]) == 1
    assert drop_copies(df.limit(0)).collect() == []


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, query(spark, sf).collect())) == sorted(con.execute(SQL).fetchall())


def test_screen_is_dealt_to_many_tasks(spark):
    """However small the snapshot, a task screens no more digests than a shard is meant to have, some more by chance."""
    rows = lambda a, z: spark.createDataFrame([(i, f"text {i}") for i in range(a, z)], "doc_id long, text string")
    for known, want in ((rows(0, 0), 0), (rows(0, 300), 300)):
        incoming = classes(digests(rows(0, 4000)))
        screened = Snapshot(digests(known), 100).screen(incoming)
        assert screened.count() == 4000 and screened.filter("maybe").count() in range(want, want + 10)
        plan = screened._jdf.queryExecution().toString()
        assert "part" in plan
