"""Events in the last half second of a window stay in it, by the query and by its SQL."""

import duckdb

from tessera.plans import streams


def test_windows_end_at_their_last_microsecond(spark, tmp_path):
    times = ["2024-01-01 05:59:59.4", "2024-01-01 05:59:59.5", "2024-01-01 05:59:59.999999", "2024-01-01 06:00:00", "1969-12-31 23:59:59.75"]
    rows = spark.createDataFrame([(t, 1.25) for t in times], "t string, value double").selectExpr("cast(t AS timestamp_ntz) AS ts", "'view' AS event_type", "value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in streams.hourly_windows(spark, str(tmp_path)).collect())
    want = sorted(duckdb.sql(streams.ORACLES["hourly_windows"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall())
    assert got == want == [(-21600, "view", 1, 1.25), (1704067200, "view", 3, 3.75), (1704088800, "view", 1, 1.25)]
