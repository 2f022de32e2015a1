"""Joins and picks that no single key can hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.lineage import cut, tallied

#: Rows of one key that a task takes; those of a key with more are dealt over several.
HOT = 4096
#: Rows that may travel to every task, and hashes.
FEW, SIEVE = 1_000_000, 2_000_000


def sieved(rows: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """Rows without most of those that ``asked`` has no equal for in the columns ``on``, as far as hashes of what
    is asked may travel to every task; else all rows. An exact join is to follow."""
    keys, (n,) = tallied(asked.select(F.xxhash64(*on).alias("_asked")).distinct())
    return rows.join(F.broadcast(keys), F.xxhash64(*on) == F.col("_asked"), "left_semi") if n <= SIEVE else rows


def split_join(left: DataFrame, right: DataFrame, keys: list[str], hot: int | None = None) -> DataFrame:
    """The inner join by equal keys, in which the left rows of a key that has many are dealt over
    tasks and its right rows copied to each. Other columns of the two must differ in name."""
    hot = hot or HOT
    parts = cut(left.groupBy(*keys).agg(F.ceil(F.count("*") / hot).cast("int").alias("_parts")).where("_parts > 1"))
    near = F.broadcast(parts) if parts.count() <= FEW else parts
    many = F.coalesce("_parts", F.lit(1))
    a = left.join(near, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), many).cast("int")).drop("_parts")
    b = right.join(near, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1))).drop("_parts")
    return a.join(b, [*keys, "_part"]).drop("_part")


def placed(rows: DataFrame, group: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Adds each row's place in its group, from 0, by a sort over all tasks and a count for each
    task and group, so that a group of any size needs no task of its own."""
    at = cut(rows.orderBy(*group, *order).withColumn("_at", F.monotonically_increasing_id()))
    at = at.withColumn("_task", F.shiftright("_at", 33))
    firsts = at.groupBy(*group, "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row for each group in a task
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.withColumn("_before", before).drop("_n")
    return at.join(firsts, [*group, "_task"]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_task", "_first", "_before")


def pick(rows: DataFrame, group: list[str], order: list[str], seed: Column) -> DataFrame:
    """One row of each group, that at the place ``seed`` modulo the group's size in order."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_size"))
    return placed(rows, group, order, "_place").join(sizes, group).where(F.col("_place") == seed % F.col("_size")).drop("_place", "_size")
