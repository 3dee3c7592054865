"""Queries against their SQL, or another reading of the rule, on small tables made to be awkward."""

import time
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver


def both(spark, folder, name, **tables):
    """Rows of a query by Spark and by DuckDB, over tables given as SQL."""
    db = duckdb.connect()
    for t, sql in tables.items():
        db.sql(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        db.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df, found = driver.queries()[name](spark, str(folder)), db.sql(driver.oracle_sql()[name])
    return Counter(tuple(r[c] for c in found.columns) for r in df.collect()), Counter(found.fetchall())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_days_round_the_second_and_keep_events_without_time(spark, tmp_path, zone):
    times = "2024-01-01 23:59:59.6, 2024-01-01 23:59:59.4, 2024-01-01 23:59:59.5, 2024-01-01 23:59:58.5, 2024-03-10 02:30:00, 1969-12-31 12:00:00, 1969-12-30 23:59:59.7, 1960-01-01 23:59:59.5".split(", ")
    rows = ", ".join(f"({k}, '{t}'::TIMESTAMP, 'view', {k}.25::DOUBLE)" for k, t in enumerate(times)) + ", (90, NULL, 'view', 1.5), (91, NULL, NULL, NULL)"
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got, want = both(spark, tmp_path, "tumbling_days", events=f"SELECT * FROM (VALUES {rows}) v(event_id, ts, event_type, value)")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == want and sum(want.values()) >= 8


def test_runs_of_long_documents_are_cut_from_words_split_once(spark, tmp_path):
    rest = "SELECT * FROM (VALUES (2::BIGINT, 'W9 w10 w11 w12 w13 w14 w15 w16', 'b'), (3, 'w9 w10 w11 w12 w13 w14 w15 w17', 'b'), (4, 'w9 w10', 'b'), (5, NULL, 'b'), (6, 'a  b c d e f g h', 'c'), (7, 'a b c d e f g h', 'c')) v(doc_id, text, source)"
    items = "SELECT * FROM (VALUES (1::BIGINT, 'so w9 w10 w11 w12 w13 w14 w15 w16'), (2, 'x a  b c d e F g'), (3, NULL), (4, 'short')) v(item_id, text)"
    got, want = both(spark, tmp_path, "decontaminate", documents=rest, benchmark=items)
    assert got == want == Counter({(3, "b"): 1, (4, "b"): 1, (5, "b"): 1, (7, "c"): 1})
    duckdb.sql(f"copy (SELECT doc_id, string_agg('w' || (doc_id + k), ' ' ORDER BY k) AS text, 'a' AS source FROM range(5, 8000, 7000) d(doc_id), range(30000) t(k) GROUP BY 1) to '{tmp_path}/documents.parquet' (format parquet)")
    begun = time.monotonic()
    assert [r["doc_id"] for r in driver.queries()["decontaminate"](spark, str(tmp_path)).collect()] == [7005]
    assert time.monotonic() - begun < 20


def test_costly_rows_of_one_file_are_dealt_to_all_cores(spark):
    for name in ("math_equality", "math_ratios", "math_identities"):
        assert driver.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
