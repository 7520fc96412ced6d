"""The streaming windowed aggregate equals the static one over the same files."""

import datetime as dt

from pyspark.sql import functions as F

from tabulon.streaming.windows import run_windowed_counts, windowed_counts


def test_stream_matches_static(spark, scratch):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i), ["a", "b"][i % 2], None if i % 5 == 0 else float(i))
            for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, kind string, v double")
    # Two files arriving one per micro-batch.
    df.filter("id < 30").write.parquet(f"{scratch}/in/part1")
    df.filter("id >= 30").write.parquet(f"{scratch}/in/part2")
    got = run_windowed_counts(spark, f"{scratch}/in/*", df.schema, f"{scratch}/sink", f"{scratch}/state",
                              key_col="kind", value_col="v", watermark="10 hours")
    static = windowed_counts(df, "ts", "kind", "v").select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "kind", "n_events", "value_sum",
        "n_missing")
    a = sorted(tuple(r) for r in got.collect())
    b = sorted(tuple(r) for r in static.collect())
    assert a == b and len(a) > 5


def test_late_files_count(spark, scratch):
    """Files written newest first, one per batch: every row counts."""
    import datetime
    import os
    schema = "ts timestamp, event_type string, value double"
    for i, day in enumerate((20, 10, 1)):
        rows = [(datetime.datetime(2024, 1, day, h), "a", 1.0) for h in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{scratch}/in/p{i}")
        for f in os.listdir(f"{scratch}/in/p{i}"):
            os.utime(f"{scratch}/in/p{i}/{f}", (1000 + i, 1000 + i))
    df = spark.read.parquet(f"{scratch}/in/*")
    got = run_windowed_counts(spark, f"{scratch}/in/*", df.schema, f"{scratch}/sink", f"{scratch}/state")
    assert sum(r.n_events for r in got.collect()) == 9
