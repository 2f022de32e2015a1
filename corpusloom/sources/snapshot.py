"""Snapshots of an index: notes, chunks and vectors in shards, under manifests that are written last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import fnv1a
from corpusloom.sources import shards

VERSION = 3
# Shards at least and at most, and the bytes that a shard should keep within.
LEAST, MOST, BUDGET = 4, 1024, 3_000_000


def estimated_bytes(text: Column) -> Column:
    """What a chunk takes at most, roughly: 1.15 bytes a character and 80 more."""
    return F.ceil(F.length(text) * 1.15) + 80


def shards_for(chunks: DataFrame, text: str = "text") -> int:
    """How many shards: doubled from ``LEAST`` until each keeps within ``BUDGET``, or ``MOST``."""
    part = F.pmod(fnv1a(F.col("path")), F.lit(MOST)).cast("int").alias("part")
    sizes = {r["part"]: r["size"] for r in chunks.groupBy(part).agg(F.sum(estimated_bytes(F.col(text))).alias("size")).collect()}  # MOST rows at most
    n = LEAST
    while n < MOST and max((sum(s for p, s in sizes.items() if p % n == k) for k in range(n)), default=0) > BUDGET:
        n *= 2
    return n


def _state(spark: SparkSession, home: str, recipe: str) -> shards.State | None:
    """The last state, if it is of this version and recipe."""
    state = shards.current(spark, home)
    return state if state and state.meta.get("version") == VERSION and state.meta.get("recipe") == recipe else None


def save(tables: dict[str, DataFrame], home: str, recipe: str, dirty: DataFrame | None = None, parts: int | None = None) -> None:
    """Writes each table (with a ``path`` column) by shard of its path.

    With ``dirty`` (``path``), only the shards of these paths are written anew, if there is a snapshot
    of the recipe and as many shards; a shard left without rows is dropped. Without
    ``parts`` there are as many shards as the snapshot has, or else as the texts need.
    A save that is killed at any point leaves the snapshot as it was; what earlier ones wrote
    and the last two don't use is swept.
    """
    spark = next(iter(tables.values())).sparkSession
    state = _state(spark, home, recipe) if dirty is not None else None
    if parts is None:
        parts = state.parts if state else max([LEAST, *(shards_for(df) for df in tables.values() if "text" in df.columns)])
    if state and (state.parts != parts or set(state.tables) != set(tables)):
        state = None  # all shards are written
    only = None
    if state:
        only = {r["part"] for r in dirty.select(shards.shard(F.col("path"), parts).alias("part")).distinct().collect()}  # as many as shards
        part = shards.shard(F.col("path"), parts)
        tables = {name: df.where(part.isin(*only) if only else F.lit(False)) for name, df in tables.items()}
    last = state or shards.current(spark, home)
    shards.replaced(spark, home, last, tables, only, parts, {"version": VERSION, "recipe": recipe})
    shards.sweep(spark, home)


def load(spark: SparkSession, home: str, recipe: str) -> dict[str, DataFrame] | None:
    """The tables, or nothing if there is no snapshot, or one of another version or recipe, or with rows missing."""
    state = _state(spark, home, recipe)
    if state is None:
        return None
    out = {}
    for name, (_, there) in sorted(state.tables.items()):
        try:
            out[name] = shards.read(spark, home, state, name)
            if out[name].count() != sum(n for _, n in there.values()):
                return None
        except Exception as e:
            if not any(x in str(e) for x in ("PATH_NOT_FOUND", "CANNOT_READ", "FAILED_READ_FILE", "does not exist")):
                raise
            return None
    return out
