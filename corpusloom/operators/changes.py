"""Change sets, staleness and incremental maintenance of stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stale(stored: DataFrame, listed: DataFrame, key: str, at: str) -> DataFrame:
    """``key, change``: new, changed (newer) and vanished rows of a listing against what is stored."""
    a, b = stored.select(key, F.col(at).alias("_old")), listed.select(key, F.col(at).alias("_new"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "vanished").when(F.col("_new") > F.col("_old"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def backfill(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Chunks without a vector of the present recipe."""
    return chunks.join(vectors.select(key).distinct(), key, "left_anti")


def drifted(manifest: DataFrame, chunks: DataFrame, key: str, count: str) -> DataFrame:
    """Notes whose chunks aren't as many as the manifest says."""
    n = chunks.groupBy(key).agg(F.count("*").alias("_n"))
    return manifest.join(n, key, "left").where(F.coalesce("_n", F.lit(0)) != F.col(count)).select(key, count, F.coalesce("_n", F.lit(0)).alias("found"))


def change_set(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """``key, type, before_hash, after_hash``: what to create, modify and delete to get from one table to the other."""
    a, b = before.select(key, F.md5(content).alias("before_hash")), after.select(key, F.md5(content).alias("after_hash"))
    kind = F.when(F.col("before_hash").isNull(), "create").when(F.col("after_hash").isNull(), "delete").when(F.col("before_hash") != F.col("after_hash"), "modify")
    return a.join(b, key, "full").select(key, kind.alias("type"), "before_hash", "after_hash").where("type is not null")


def conflicts(changes: DataFrame, current: DataFrame, key: str, content: str) -> DataFrame:
    """Changes whose base isn't what is there now; a set is applied only if there are none."""
    now = current.select(key, F.md5(content).alias("_now"))
    return changes.join(now, key, "left").where(~F.col("before_hash").eqNullSafe(F.col("_now"))).drop("_now")


def inverse(changes: DataFrame) -> DataFrame:
    """The change set that undoes another."""
    kind = F.when(F.col("type") == "create", "delete").when(F.col("type") == "delete", "create").otherwise("modify")
    return changes.select(*[c for c in changes.columns if c not in ("type", "before_hash", "after_hash")], kind.alias("type"), F.col("after_hash").alias("before_hash"), F.col("before_hash").alias("after_hash"))


def unique_names(moves: DataFrame, taken: DataFrame) -> DataFrame:
    """``src, target``: every target is free and given once.

    A name that is wanted goes to its first source, unless it is taken; all others get
    the name with " 2", " 3" and so on, whatever number is neither taken nor wanted as
    such. Each source's number follows from its place among those that want the name and
    from the numbers that are gone, so no name is tried after another.
    """
    stem, ext = (lambda c: F.regexp_replace(c, r"(\.[^./]+)$", "")), (lambda c: F.regexp_extract(c, r"(\.[^./]+)$", 1))
    numbered = r"^([\s\S]*) ([1-9][0-9]{0,8})$"
    gone = moves.select("target").unionByName(taken.select("target")).distinct().select(stem(F.col("target")).alias("s"), ext(F.col("target")).alias("e"))
    gone = gone.where(F.col("s").rlike(numbered)).select(F.concat(F.regexp_extract("s", numbered, 1), "e").alias("target"), F.regexp_extract("s", numbered, 2).cast("long").alias("n"))
    gone = gone.where("n > 1").groupBy("target").agg(F.array_sort(F.collect_list("n")).alias("gone"))
    want = moves.select("src", "target").join(taken.select("target").distinct().withColumn("there", F.lit(1)), "target", "left")
    place = F.row_number().over(Window.partitionBy("target").orderBy("src")) - F.when(F.col("there").isNull(), 1).otherwise(0)
    want = want.withColumn("place", place).join(gone, "target", "left")
    # the place-th number from 2 on that isn't gone: as many more as there are gone ones with fewer free ones before them
    before = F.size(F.filter(F.transform(F.coalesce("gone", F.array().cast("array<long>")), lambda g, i: g - 2 - i), lambda free: free < F.col("place")))
    name = F.concat(stem(F.col("target")), F.lit(" "), (F.col("place") + 1 + before).cast("string"), ext(F.col("target")))
    return want.select("src", F.when(F.col("place") == 0, F.col("target")).otherwise(name).alias("target"))


def union_tail(a: Column, b: Column, most: int = 60) -> Column:
    """The ordered union of two lists, the last ones if it is too long."""
    u = F.array_union(a, b)
    return F.slice(u, F.greatest(F.lit(1), F.size(u) - most + 1), most)


def block_union(kept: Column, other: Column) -> Column:
    """Blocks of the second text that the first doesn't have, white space aside."""
    norm = lambda b: F.lower(F.trim(F.regexp_replace(b, r"[ \t\n\x0B\f\r]+", " ")))
    have = F.transform(F.split(kept, "\n"), norm)
    return F.filter(F.split(other, "\n"), lambda b: (norm(b) != "") & ~F.array_contains(have, norm(b)))
