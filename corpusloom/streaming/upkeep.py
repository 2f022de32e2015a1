"""An index that follows a feed of changes to notes.

Changes create, modify, delete and rename notes. Of each batch the last change of every
path counts, and only if nothing later is stored. What a note is made into
(chunks, say) is made before anything is taken away; then the shards of the touched paths
are written anew and all others stay, so the bytes written follow the batch, and one
manifest makes everything visible at once. Deleted notes leave tombstones, so that a late
change can't bring them back. A note that fails is tried three times in all, with the batches that
come, and then parked; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from corpusloom.sources import shards
from corpusloom.sources.lineage import cut

#: How often a note is tried before it is parked.
TRIES = 3
PARTS = 64
_ORDER = ("at", "seq")


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each path, from ``path, old_path, op, at, seq`` and the note's own columns.

    ``op`` is modify (or create), delete or rename: a rename deletes ``old_path`` and modifies ``path``.
    Without ``path`` or ``at`` a change says nothing. Of changes at one time and ``seq``, a note that is there wins.
    """
    cells = [c for c in changes.columns if c not in ("path", "old_path", "op")]
    gone = F.col("op") == "delete"
    there = changes.select("path", gone.alias("deleted"), *cells)
    moved = changes.where("op = 'rename' and old_path is not null").select(F.col("old_path").alias("path"), F.lit(True).alias("deleted"), *cells)
    rows = there.unionByName(moved).where("path is not null and at is not null")
    row = F.struct("deleted", *cells)
    last = rows.groupBy("path").agg(F.max_by(row, F.struct(*_ORDER, ~F.col("deleted"))).alias("r"))
    return last.select("path", "r.*")


def made(notes: DataFrame, make: Callable[[dict], Iterable[tuple]], schema: str) -> DataFrame:
    """``path, error, units``: what ``make`` gives for each note, or the error that it raised, so that no note takes others with it."""
    unit = StructType.fromDDL(schema)
    names = [f.name for f in unit.fields]

    def run(batches):
        import pandas as pd

        for df in batches:
            error, units = [], []
            for note in df.to_dict("records"):
                try:
                    units.append([dict(zip(names, u, strict=True)) for u in make(note)])
                    error.append(None)
                except Exception as e:
                    units.append(None)
                    error.append(f"{type(e).__name__}: {e}"[:500])
            yield pd.DataFrame({"path": df["path"], "error": error, "units": units})

    return notes.mapInPandas(run, f"path string, error string, units array<{unit.simpleString()}>")


def apply(spark: SparkSession, home: str, changes: DataFrame | None, number: int | None, make: Callable[[dict], Iterable[tuple]], schema: str, parts: int = PARTS) -> shards.State | None:
    """Applies a batch, and tries again what failed before.

    The tables of the store are ``notes`` (with tombstones), ``units`` (``path`` and what ``make`` gives)
    and ``failures`` (the change, ``tries`` and ``error``; parked from ``TRIES`` on).
    A batch whose ``number`` isn't above the last one applied has been applied: nothing
    happens. A batch that was cut off is applied from the start.
    """
    state = shards.current(spark, home)
    if number is not None and state and state.meta["batch"] >= number:
        return state
    parts, meta = (state.parts, dict(state.meta)) if state else (parts, {"batch": -1})
    if number is not None:
        meta["batch"] = number
    waiting, fails = set(), None
    if state:
        waiting = {int(p) for p in meta.get("waiting", [])}
        fails = shards.read(spark, home, state, "failures", waiting).where(F.col("tries") < TRIES).drop("tries", "error")
    if changes is None and not waiting:
        return state
    last = last_changes(changes) if changes is not None else fails.limit(0)
    if fails is not None:
        both = last.unionByName(fails)
        last = both.groupBy("path").agg(F.max_by(F.struct(*[c for c in both.columns if c != "path"]), F.struct(*_ORDER)).alias("r")).select("path", "r.*")
    last = cut(last)
    part = shards.shard(F.col("path"), parts)
    touched = {r["part"] for r in last.select(part.alias("part")).distinct().collect()} | waiting  # as many as shards
    note_schema = StructType([f for f in last.schema.fields])
    old = {name: shards.read(spark, home, state, name, touched) if state else None for name in ("notes", "units", "failures")}
    if state is None:
        unit_schema = StructType.fromDDL(f"path string, {schema}")
        old = {"notes": spark.createDataFrame([], note_schema), "units": spark.createDataFrame([], unit_schema), "failures": spark.createDataFrame([], StructType([*note_schema.fields]).add("tries", IntegerType()).add("error", StringType()))}
    stored = old["notes"].select("path", F.struct(*_ORDER).alias("_stored"))
    given_up = old["failures"].select("path", F.struct(*_ORDER).alias("_failed"), F.col("tries").alias("_tries"))
    later = (F.col("_stored").isNull() | (F.struct(*_ORDER) > F.col("_stored"))) & (F.col("_failed").isNull() | (F.struct(*_ORDER) >= F.col("_failed")))
    news = cut(last.join(stored, "path", "left").join(given_up, "path", "left").where(later).drop("_stored", "_failed"))
    tried = cut(made(news.where("not deleted"), make, schema))
    failed, done = tried.where("error is not null").select("path", "error"), tried.where("error is null")
    # what is settled: deleted or made
    settled = news.join(failed.select("path"), "path", "left_anti")
    again = news.join(failed, "path").withColumn("tries", (F.coalesce("_tries", F.lit(0)) + 1).cast("int"))
    keep = lambda name, gone: old[name].join(gone.select("path"), "path", "left_anti")
    units = done.select("path", F.explode("units").alias("u")).select("path", "u.*")
    blank = [F.when(~F.col("deleted") | F.lit(c in ("path", "deleted", *_ORDER)), F.col(c)).alias(c) for c in note_schema.names]
    tables = {
        "notes": keep("notes", settled).unionByName(settled.select(*blank)),
        "units": keep("units", settled).unionByName(units),
        "failures": keep("failures", news).unionByName(again.select(*old["failures"].columns)),
    }
    tables = {name: df.select(*old[name].columns) for name, df in tables.items()}
    tables["failures"] = cut(tables["failures"])
    left = {r["part"] for r in tables["failures"].where(F.col("tries") < TRIES).select(part.alias("part")).distinct().collect()}
    meta["waiting"] = sorted(left)
    return shards.replaced(spark, home, state, tables, touched, parts, meta)


def notes(spark: SparkSession, home: str) -> DataFrame:
    """The notes that are there."""
    state = shards.current(spark, home)
    return shards.read(spark, home, state, "notes").where("not deleted").drop("deleted")


def units(spark: SparkSession, home: str) -> DataFrame:
    return shards.read(spark, home, shards.current(spark, home), "units")


def parked(spark: SparkSession, home: str) -> DataFrame:
    """Changes that were given up, with their last error."""
    return shards.read(spark, home, shards.current(spark, home), "failures").where(F.col("tries") >= TRIES)


def follow(feed: DataFrame, home: str, make: Callable[[dict], Iterable[tuple]], schema: str, parts: int = PARTS) -> None:
    """Applies a stream of changes batch by batch until it ends, then tries what still waits.

    Started again after a crash, it goes on with the batch that wasn't committed."""
    spark = feed.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        apply(spark, home, rows, number, make, schema, parts)
        shards.sweep(spark, home)

    feed.writeStream.foreachBatch(batch).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start().awaitTermination()
    for _ in range(TRIES):
        state = shards.current(spark, home)
        if not state or not state.meta.get("waiting"):
            break
        apply(spark, home, None, None, make, schema, parts)


def forget(spark: SparkSession, home: str, before: str) -> None:
    """Drops tombstones of notes deleted before a time; changes older than that must not come any more."""
    state = shards.current(spark, home)
    rows = shards.read(spark, home, state, "notes")
    old = F.col("deleted") & (F.col("at") < F.lit(before).cast("timestamp"))
    dirty = {r["part"] for r in rows.where(old).select(shards.shard(F.col("path"), state.parts).alias("part")).distinct().collect()}
    if dirty:
        tables = {name: shards.read(spark, home, state, name, dirty) for name in state.tables}
        tables["notes"] = tables["notes"].where(~old)
        shards.replaced(spark, home, state, tables, dirty, state.parts, dict(state.meta))
