"""Change feeds and event windows with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.lineage import shared_folder


def _home(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark, 'corpusloom-feed-')}/feed-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 4) -> DataFrame:
    """A table of the folder as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a table in one file is found by a glob that only its own name meets; a folder is listed
    own = path[:-1] + "[" + path[-1] + "]"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(own)


def upsert(feed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key after the whole feed, one batch after another.

    Every batch is reduced to its last row per key before it is merged with the stored
    state, which is written anew beside the old one, so a lost batch can be repeated.
    """
    spark, home = feed.sparkSession, _home(feed.sparkSession)
    at = {"path": None}

    def last(df: DataFrame) -> DataFrame:
        return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*order)).alias("s")).select(key, "s.*")

    def merge(batch: DataFrame, number: int) -> None:
        rows = last(batch)
        if at["path"]:
            rows = last(rows.unionByName(spark.read.parquet(at["path"])))
        path = f"{home}/state-{number}"
        rows.write.mode("overwrite").parquet(path)
        at["path"] = path

    feed.writeStream.foreachBatch(merge).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(at["path"]) if at["path"] else spark.createDataFrame([], feed.schema)


def idempotent(feed: DataFrame, keys: list[str]) -> DataFrame:
    """The feed with each key once, whatever came in twice: state is kept for every key."""
    spark, home = feed.sparkSession, _home(feed.sparkSession)
    feed.dropDuplicates(keys).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(feed.schema).parquet(f"{home}/out")


def windowed(feed: DataFrame, at: str, window: Column, by: list[str]) -> DataFrame:
    """Counts and sums of ``value`` per window; an extension, the model has no event time.

    Update mode into a folder of batches; the last update of a window counts. Files may come
    in any order of time, so there is no watermark: the feed ends, and no row is too late."""
    spark, home = feed.sparkSession, _home(feed.sparkSession)
    counted = feed.groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    flat = counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    flat.writeStream.foreachBatch(keep).option("checkpointLocation", f"{home}/log").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    try:
        rows = spark.read.parquet(f"{home}/out")
    except Exception as e:  # nothing came in
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        return spark.createDataFrame([], flat.schema)
    return rows.groupBy("start", "end", *by).agg(F.max_by(F.struct("n", "total"), "batch").alias("s")).select("start", "end", *by, "s.*")
