"""Closing windows and sessions over files out of time order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import shards
from corpusloom.streaming import feeds, late

DAY = dt.datetime(2024, 1, 1)
ROWS = "event_id long, ts timestamp, kind string, value double"
WINDOWS = "start timestamp, end timestamp, kind string, n long, total double"
LATE = f"start timestamp, {ROWS}"


def events(n=400, seed=1):
    r = random.Random(seed)
    return [(i, DAY + dt.timedelta(minutes=r.randrange(6000)), "ab"[i % 2], float(r.randrange(9))) for i in range(n)] + [(n, None, "a", 1.0)]


def plain_windows(batches, length, step, delay):
    """Closed, open and late rows, batch by batch; minutes from ``DAY``."""
    mark, opened, closed, too_late = None, {}, {}, []
    minutes = lambda t: (t - DAY).total_seconds() / 60
    for rows in batches:
        for row in rows:
            if row[1] is None:
                too_late.append((None, row[0]))
                continue
            t = minutes(row[1])
            first = int(t // step) * step
            for start in range(first, int(t - length), -step):
                if start > t - length:
                    if mark is not None and start + length <= mark:
                        too_late.append((start, row[0]))
                    else:
                        n, total = opened.get((start, row[2]), (0, 0.0))
                        opened[start, row[2]] = n + 1, total + row[3]
        times = [minutes(r[1]) for r in rows if r[1] is not None]
        mark = max([*([] if mark is None else [mark]), *([max(times) - delay] if times else [])], default=None)
        for key in [k for k in opened if mark is not None and k[0] + length <= mark]:
            closed[key] = opened.pop(key)
    return closed, opened, sorted(too_late, key=repr)


def flat(df):
    return {((r.start.replace(tzinfo=None) - DAY).total_seconds() / 60, r.kind): (r.n, r.total) for r in df.collect()}


@pytest.mark.parametrize("step", [60, 30])
@pytest.mark.parametrize("order", ["sorted", "mixed"])
def test_windows_close_and_late_rows_are_kept(spark, tmp_path, step, order):
    rows, home = events(), str(tmp_path / "w")
    if order == "sorted":
        rows.sort(key=lambda r: (r[1] is None, r[1] or DAY))
    batches = [rows[k::5] if order == "mixed" else rows[k * 81 : k * 81 + 81] for k in range(5)]
    window = lambda: F.window("ts", "60 minutes", f"{step} minutes")
    for k, b in enumerate(batches):
        late.apply(spark, home, spark.createDataFrame(b, ROWS), k, window, ["kind"], "90 minutes")
    want = plain_windows(batches, 60, step, 90)
    closed, opened, missed = late.closed(spark, home, WINDOWS), late.still_open(spark, home, WINDOWS), late.too_late(spark, home, LATE)
    assert flat(closed) == want[0] and flat(opened) == want[1]
    got = sorted(((r.start and (r.start - DAY).total_seconds() / 60, r.event_id) for r in missed.collect()), key=repr)
    assert got == want[2] and (len(got) > 1) == (order == "mixed")
    # nothing is lost: windows and late rows make up what a batch counts
    every = spark.createDataFrame(rows, ROWS).where("ts is not null").groupBy(window().alias("w"), "kind").count()
    total = closed.unionByName(opened).select("start", "kind", "n").unionByName(missed.where("ts is not null").select("start", "kind", F.lit(1).cast("long").alias("n"))).groupBy("start", "kind").agg(F.sum("n").alias("n"))
    assert sorted(total.collect()) == sorted(every.select("w.start", "kind", "count").collect())
    # state is freed: but for the last 90 minutes all windows are closed, and only the last open table is kept
    assert len(want[1]) <= 2 * (150 // step + 1)
    assert len(list((tmp_path / "w" / "open").iterdir())) == 1
    late.apply(spark, home, spark.createDataFrame(batches[0], ROWS), 2, window, ["kind"], "90 minutes")
    assert flat(late.closed(spark, home, WINDOWS)) == want[0]


def test_sessions_merge_over_batches(spark, tmp_path):
    rows, home = [r for r in events(300, 4) if r[1]], str(tmp_path / "s")
    rows.sort(key=lambda r: r[1])
    # batches overlap in time by less than the delay
    keyed = sorted(rows, key=lambda r: (r[1] - DAY).total_seconds() // 60 + random.Random(r[0]).randrange(100))
    for k in range(6):
        late.apply(spark, home, spark.createDataFrame(keyed[k * 50 : k * 50 + 50], ROWS), k, "30 minutes", ["kind"], "120 minutes", session=True)
    assert late.too_late(spark, home, LATE).count() == 0
    every = spark.createDataFrame(rows, ROWS).groupBy(F.session_window("ts", "30 minutes").alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "kind", "n", "total")
    assert sorted(late.closed(spark, home, WINDOWS).unionByName(late.still_open(spark, home, WINDOWS)).collect()) == sorted(every.collect())
    assert late.closed(spark, home, WINDOWS).count() > late.still_open(spark, home, WINDOWS).count()


def test_feed_of_files_and_a_crash(spark, tmp_path, monkeypatch):
    rows, home = events(200, 8), str(tmp_path / "w")
    spark.createDataFrame(rows, ROWS).repartition(5, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    real, failed = shards.commit, []

    def once(*a):
        if not failed and a[2].number == 2:
            failed.append(1)
            raise KeyError("killed")
        return real(*a)

    monkeypatch.setattr(shards, "commit", once)
    follow = lambda: late.follow(feeds.stream(spark, str(tmp_path), "events", 1), home, lambda: F.window("ts", "1 hour"), ["kind"], "1 hour")
    with pytest.raises(Exception, match="killed"):
        follow()
    follow()
    n = sum(r.n for t in (late.closed, late.still_open) for r in t(spark, home, WINDOWS).collect())
    assert failed and n + late.too_late(spark, home, LATE).count() == len(rows)
