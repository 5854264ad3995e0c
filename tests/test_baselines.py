"""Baselines against their SQL where a step equals the tolerance and where columns are null."""

import math
from datetime import datetime

import duckdb

import __spark_entry__ as entry


def test_steps_at_the_tolerance_and_nulls(spark, tmp_path):
    """A step of 0.35 of each size, the doubles beside it, and rows that only the place of nulls orders."""
    rows, at = [], datetime(2024, 1, 1)
    for user in range(12):
        step = user * 35 / 100
        for k, other in enumerate((step, math.nextafter(step, 9), math.nextafter(step, 0), 0.35 * user)):
            rows += [(12 * len(rows) + user, at, 100 * k + user, other), (12 * len(rows) + user + 1, at, 100 * k + user, 0.0)]
    rows += [(1, None, 900, 9.0), (11, at, 900, 9.0), (22, None, 900, 6.5), (23, at, 900, None), (34, None, 900, None), (None, at, 901, 7.0), (7, at, 901, 5.5)]
    rows += [(8, at, 902, float("nan")), (9, at, 902, 4.0), (3, at, None, 4.0), (5, at, None, 2.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["baseline_groups"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    expected = con.execute(f"SELECT user_id, event_id, line FROM ({entry.oracle_sql()['baseline_groups']})").fetchall()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in got)
