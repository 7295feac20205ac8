"""Dates found in documents, against a plain search for the two forms that the fixture has."""

import re
from datetime import datetime

import duckdb

from millrace.queries import QUERIES, SQL

MONTHS = "January February March April May June July August September October November December".split()


def brute(text):
    out = []
    for m in re.finditer(rf"\b(\d{{4}})-(\d\d?)-(\d\d?)(?!\d)|\b({'|'.join(MONTHS)}) (\d\d?), (\d{{4}})(?!\d)", text):
        y, mo, d = (m[1], m[2], m[3]) if m[1] else (m[6], MONTHS.index(m[4]) + 1, m[5])
        try:
            out.append(str(datetime(int(y), int(mo), int(d))))
        except ValueError:
            continue
    return "|".join(out)


def test_dates_of_all_documents(spark, tmp_path):
    texts = ["Signed on 2023-10-15.", "From March 3, 2021 to 2022-01-31, then no more", "no date, though 1234 has four digits", "on 2023-13-45 nothing happened", "no digits", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.dates for r in QUERIES["datetime_extraction_documents"](spark, str(tmp_path)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert got[1] == "2021-03-03 00:00:00|2022-01-31 00:00:00"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.execute(SQL["datetime_extraction_documents"]).fetchall()) == got
