"""Event windows over files that are out of time order."""

import datetime as dt

from pyspark.sql import functions as F

from corpusloom.streaming import feeds


def test_windows_keep_rows_of_files_out_of_time_order(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(minutes=(i * 577) % 14400), "ab"[i % 2], float(i % 7)) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    events.repartition(11, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    for window in (F.window("ts", "1 hour"), F.window("ts", "1 hour", "30 minutes")):
        got = feeds.windowed(feeds.stream(spark, str(tmp_path), "events"), "ts", window, ["event_type"]).select("start", "end", "event_type", "n", "total")
        want = events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("w.start", "w.end", "event_type", "n", "total")
        assert sorted(got.collect()) == sorted(want.collect())


def test_stream_reads_its_own_table_alone(spark, tmp_path):
    rows = [(i, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id long, value double")
    df.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    df.write.parquet(f"{tmp_path}/events.parquet_old")
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    part = next(p for p in (tmp_path / "one").iterdir() if p.name.endswith(".parquet"))
    part.rename(tmp_path / "single.parquet")
    for name in ("events", "single"):
        got = feeds.idempotent(feeds.stream(spark, str(tmp_path), name), ["event_id"])
        assert sorted(map(tuple, got.collect())) == rows
