"""Tables in shards by a hash of their path, under numbered manifests.

A manifest names, for each shard of each table, the run that wrote it and its rows. It never
changes: the next one is written aside and renamed to the next number, so that a
reader sees one state or the other, whenever a writer is killed. A writer writes the shards
that it changes, all others stay with the runs that wrote them. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from corpusloom.functions.text import fnv1a


class State(NamedTuple):
    """One manifest: its number, how many shards there are, facts of the writer, and of each table the schema and ``run, rows`` by shard."""

    number: int
    parts: int
    meta: dict
    tables: dict[str, tuple[StructType, dict[int, tuple[str, int]]]]


def shard(path: Column, parts: int) -> Column:
    return F.pmod(fnv1a(path), F.lit(parts)).cast("int")


def _store(spark: SparkSession, path: str):
    """A Hadoop path and its file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, home: str) -> list[int]:
    """The manifests that are there, oldest first."""
    at, fs = _store(spark, f"{home}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def current(spark: SparkSession, home: str, number: int | None = None) -> State | None:
    """The last state, or that of a number; nothing if there is none."""
    number = max(numbers(spark, home), default=None) if number is None else number
    if number is None:
        return None
    at, fs = _store(spark, f"{home}/manifests/{number:012d}.json")
    stream = fs.open(at)
    try:
        raw = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    tables = {name: (StructType.fromJson(t["schema"]), {int(p): (run, n) for p, (run, n) in t["shards"].items()}) for name, t in raw["tables"].items()}
    return State(number, raw["parts"], raw["meta"], tables)


def commit(spark: SparkSession, home: str, state: State) -> None:
    """Makes a state the last one, all at once."""
    raw = {"parts": state.parts, "meta": state.meta, "tables": {name: {"schema": schema.jsonValue(), "shards": shards} for name, (schema, shards) in state.tables.items()}}
    target, fs = _store(spark, f"{home}/manifests/{state.number:012d}.json")
    aside, _ = _store(spark, f"{home}/manifests/aside-{uuid.uuid4().hex}")
    out = fs.create(aside)
    try:
        out.write(bytearray(json.dumps(raw).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        raise RuntimeError(f"manifest {state.number} of {home} was written by someone else")


def written(spark: SparkSession, home: str, name: str, rows: DataFrame, parts: int) -> dict[int, tuple[str, int]]:
    """Writes rows by the shard of their path; ``run, rows`` of the shards that have any."""
    run = uuid.uuid4().hex
    rows.withColumn("part", shard(F.col("path"), parts)).repartition("part").write.partitionBy("part").parquet(f"{home}/{name}/run={run}")
    there = spark.read.schema(StructType([*rows.schema.fields]).add("part", IntegerType())).parquet(f"{home}/{name}/run={run}").groupBy("part").count().collect()  # as many as shards
    return {r["part"]: (run, r["count"]) for r in there}


def read(spark: SparkSession, home: str, state: State, name: str, only: set[int] | None = None) -> DataFrame:
    """A table, or its shards in ``only``."""
    schema, shards = state.tables[name]
    paths = [f"{home}/{name}/run={run}/part={p}" for p, (run, _) in sorted(shards.items()) if only is None or p in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replaced(spark: SparkSession, home: str, state: State | None, tables: dict[str, DataFrame], dirty: set[int] | None, parts: int, meta: dict) -> State:
    """Commits new rows of the ``dirty`` shards (all if none are named) of each table; a shard left without rows is dropped."""
    out = {}
    for name, rows in tables.items():
        had = state.tables[name][1] if state and dirty is not None and name in state.tables else {}
        out[name] = rows.schema, {p: x for p, x in had.items() if p not in dirty} | (written(spark, home, name, rows, parts) if dirty is None or dirty else {})
    new = State(state.number + 1 if state else max(numbers(spark, home), default=-1) + 1, parts, meta, out)
    commit(spark, home, new)
    return new


def sweep(spark: SparkSession, home: str, keep: int = 2) -> int:
    """Removes all manifests but the last ``keep``, and the runs that none of these names; how many runs went.

    Readers of older states must be done; a run that is being written must not be there."""
    there = numbers(spark, home)
    states = [current(spark, home, n) for n in there[-keep:]]
    for n in there[:-keep]:
        at, fs = _store(spark, f"{home}/manifests/{n:012d}.json")
        fs.delete(at, False)
    gone = 0
    at, fs = _store(spark, home)
    for folder in fs.listStatus(at) if fs.exists(at) else []:
        name = folder.getPath().getName()
        if name == "manifests":
            for x in fs.listStatus(folder.getPath()):
                if x.getPath().getName().startswith("aside-"):
                    fs.delete(x.getPath(), False)
            continue
        used = {run for s in states if name in s.tables for run, _ in s.tables[name][1].values()}
        for run in fs.listStatus(folder.getPath()) if folder.isDirectory() else []:
            if run.getPath().getName().startswith("run=") and run.getPath().getName()[4:] not in used:
                fs.delete(run.getPath(), True)
                gone += 1
    return gone
