"""Windows and sessions of a feed that close, with a table of the rows that come too late.

Batches are merged into the windows that are open. After each batch the watermark, the
latest time seen less a delay, closes windows that end before it: they are appended to what is
closed and their state is freed. A row whose window ended before the watermark of earlier
batches is late: it changes nothing and goes to a table of its own, so no row is lost.
What is open, what is closed and what was late are all tables, and one manifest for each batch
makes them visible at once; a batch that is cut off is done again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources import shards


def _merged_sessions(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sessions of one key that overlap or touch become one; ``start, end, by, n, total``."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("_k", F.sum(F.when(before >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return fresh.groupBy(*by, "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.sum("total").alias("total")).drop("_k")


def _merged_windows(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy("start", "end", *by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def apply(spark: SparkSession, home: str, batch: DataFrame, number: int, window: Callable[[], Column], by: list[str], delay: str, value: str = "value", at: str = "ts", session: bool = False) -> None:
    """Merges one batch. ``window`` gives the column of windows of ``at`` (tumbling, sliding, or a session's
    with ``session``), ``delay`` is how far rows may lag behind the latest, as an interval.

    Rows without a time are late. A sliding window can be closed for a row that is in time for another.
    """
    state = shards.current(spark, home)
    if state and state.meta["batch"] >= number:
        return
    meta = state.meta if state else {"watermark": None, "open": None, "batches": []}
    mark = F.lit(meta["watermark"]).cast("timestamp")
    span = F.session_window(F.col(at), window) if isinstance(window, str) else window()
    if session:
        # a session of one row, to tell whether it is late; rows are merged when they are counted
        rows = batch.withColumn("_w", F.struct(F.col(at).alias("start"), (F.col(at) + F.expr(f"INTERVAL {window}")).alias("end")))
    else:
        rows = batch.withColumn("_w", span)
        rows = rows.unionByName(batch.where(F.col(at).isNull()).withColumn("_w", F.lit(None).cast(rows.schema["_w"].dataType)))
    late = F.coalesce(F.col("_w.end") <= mark, F.lit(False)) | F.col(at).isNull()
    rows.where(late).select(F.col("_w.start").alias("start"), *batch.columns).write.mode("overwrite").parquet(f"{home}/late/batch={number}")
    fresh = rows.where(~late)
    counted = (F.count("*").alias("n"), F.sum(value).alias("total"))
    if session:
        fresh = fresh.drop("_w").groupBy(span.alias("w"), *by).agg(*counted).select("w.start", "w.end", *by, "n", "total")
    else:
        fresh = fresh.groupBy(F.col("_w").alias("w"), *by).agg(*counted).select("w.start", "w.end", *by, "n", "total")
    if meta["open"] is not None:
        fresh = fresh.unionByName(spark.read.schema(fresh.schema).parquet(f"{home}/open/batch={meta['open']}"))
    merged = (_merged_sessions if session else _merged_windows)(fresh, by).select("start", "end", *by, "n", "total")
    latest = batch.agg((F.max(at).cast("timestamp") - F.expr(f"INTERVAL {delay}")).alias("m")).first()["m"]
    marks = [m for m in (meta["watermark"], latest and latest.astimezone(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%fZ")) if m]
    new = max(marks, default=None)  # written alike, so the later one is the greater text
    done = F.coalesce(F.col("end") <= F.lit(new).cast("timestamp"), F.lit(False))
    merged.withColumn("done", done).write.mode("overwrite").partitionBy("done").parquet(f"{home}/merged/batch={number}")
    both = spark.read.schema(f"{merged.withColumn('done', done).schema.simpleString()[7:-1].replace(':', ' ')}").parquet(f"{home}/merged/batch={number}")
    both.where("not done").drop("done").write.mode("overwrite").parquet(f"{home}/open/batch={number}")
    both.where("done").drop("done").write.mode("overwrite").parquet(f"{home}/closed/batch={number}")
    shards.commit(spark, home, shards.State(state.number + 1 if state else 0, 1, {"batch": number, "watermark": new, "open": number, "batches": [*meta["batches"], number]}, {}))
    for gone in (f"{home}/merged/batch={number}", f"{home}/open/batch={meta['open']}"):
        path, fs = shards._store(spark, gone)
        fs.delete(path, True)


def _table(spark: SparkSession, home: str, name: str, columns: str) -> DataFrame:
    state = shards.current(spark, home)
    numbers = (state.meta["batches"] if name != "open" else [state.meta["open"]]) if state else []
    return spark.read.schema(columns).parquet(*(f"{home}/{name}/batch={n}" for n in numbers)) if numbers else spark.createDataFrame([], columns)


def closed(spark: SparkSession, home: str, columns: str) -> DataFrame:
    """``start, end``, the keys, ``n, total`` of windows that were closed; each once, but for sessions that went on after they were closed."""
    return _table(spark, home, "closed", columns)


def still_open(spark: SparkSession, home: str, columns: str) -> DataFrame:
    return _table(spark, home, "open", columns)


def too_late(spark: SparkSession, home: str, columns: str) -> DataFrame:
    """``start`` of the window that was closed, and the row."""
    return _table(spark, home, "late", columns)


def follow(feed: DataFrame, home: str, window, by: list[str], delay: str, value: str = "value", at: str = "ts", session: bool = False) -> None:
    """Merges a stream batch by batch until it ends; started again, it goes on with the batch that wasn't finished."""
    spark = feed.sparkSession
    run = lambda rows, number: apply(spark, home, rows, number, window, by, delay, value, at, session)
    feed.writeStream.foreachBatch(run).option("checkpointLocation", f"{home}-feed").trigger(availableNow=True).start().awaitTermination()
