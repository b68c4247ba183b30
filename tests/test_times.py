"""Queries on times with parts of milliseconds, which DuckDB's epoch_ms rounds."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import catalog


def same_as_sql(spark, folder, name, event_type, micros, value):
    """The query's rows, which are those of its SQL, over events at these microseconds after an epoch."""
    n = len(micros)
    ts = [datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us) for us in micros]
    events = pa.table({"event_id": range(n), "ts": pa.array(ts, pa.timestamp("us")), "user_id": [7] * n, "event_type": [event_type] * n, "value": [value] * n, "props": ['{"k": 3}'] * n})
    pq.write_table(events, folder / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    got = catalog.queries()[name](spark, str(folder))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
    return got.orderBy("event_id").collect()


@pytest.mark.parametrize("day", [0, 19_700])
def test_failures_count_rounded_milliseconds(spark, tmp_path, day):
    """Five failures within ten seconds by whole milliseconds, but not by rounded ones, and the reverse."""
    at = [day * 86_400_000_000 + us for us in (400, 1_000_000, 2_000_000, 3_000_000, 10_000_500, 60_000_500, 61_000_000, 62_000_000, 63_000_000, 70_001_499)]
    assert [r.burst for r in same_as_sql(spark, tmp_path, "g4_failures", "error", at, 1.0)] == [False] * 9 + [True]


def test_fetches_are_shared_by_rounded_milliseconds(spark, tmp_path):
    """Fetches take 5 ms: one from 0.6 ms on ends at 6 ms, which the request at 5.4 ms shares."""
    at = [-5_500, -500, -499, 600, 5_400, 10_400, 20_400, 25_500]
    assert [r.shared for r in same_as_sql(spark, tmp_path, "k3_coalescing", "view", at, 0.05)] == [False, False, True, True, True, False, False, False]
