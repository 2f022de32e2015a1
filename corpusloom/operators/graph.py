"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.lineage import cut, tallied


#: Edges that one task rewires at least, and nodes whose least neighbours may travel to all tasks.
_TASK_EDGES, _FEW_NODES = 100_000, 1_000_000


def _ends(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """``u, v``: of each row one edge for each of the named pairs of columns."""
    return rows.select(F.explode(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs))).alias("edge")).select("edge.u", "edge.v")


def _nearest(edges: DataFrame, n: int, few: int) -> DataFrame:
    """Edges with ``m``, the least v that their u has.

    What one task holds stays there, without a shuffle or a table that travels through the driver."""
    if few == 1:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    near = F.broadcast if n <= _FEW_NODES else lambda x: x
    return edges.join(near(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(few)), "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of the edges; component = least node reachable.

    Alternates the large-star and small-star rewiring of Kiveris et al. (2014), so
    a chain of n edges needs about log n rounds. Only a row count and a checksum of
    each round come to the driver. Null ends and self loops are dropped; repeated
    edges count once; an empty edge table gives an empty result.
    """
    ends = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), F.col(src).isNull().alias("a"), F.col(dst).isNull().alias("b"))
    told = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))
    e, now = tallied(ends.where("not a and not b and u <> v").select("u", "v").distinct(), *told)
    seen = None
    for _ in range(max_rounds):
        if now == seen:
            break
        seen, few = now, 1 + now[0] // _TASK_EDGES
        if few == 1 or e.rdd.getNumPartitions() > few:
            e = e.coalesce(few)
        large = _nearest(_ends(e, ("u", "v"), ("v", "u")), now[0], few).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _ends(_nearest(large, now[0], few), ("v", "m"), ("u", "m")).where("u <> v")
        # never more edges than before, so no more tasks are needed
        e, now = tallied(small.distinct().coalesce(few), *told)
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
