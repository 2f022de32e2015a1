"""Scores, fusion and confidence of ranked results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.crossing import crossed, packed
from corpusloom.operators.spread import placed
from corpusloom.sources.lineage import cut

#: Queries and members of a set in a task's block, and queries in an Arrow batch.
ASKED, HELD, SENT = 1024, 4096, 16
RRF_K = 60
# Knots from raw cosines to the scale of the thresholds, for one embedding recipe.
KNOTS = ((0.458, 0.463), (0.513, 0.521), (0.571, 0.585), (0.605, 0.624), (0.633, 0.654), (0.666, 0.688), (0.692, 0.713), (0.741, 0.761))


def rrf(lists: DataFrame, k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal-rank fusion of ``list_id, id, rank`` (from 0): ``id, fused``, of each ``by``."""
    return lists.groupBy(*by, "id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("fused"))


def collapse(ranked: DataFrame, group: str, score: str = "fused", tie: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """The best row of each group; equal scores go by ``tie``."""
    best = Window.partitionBy(*by, group).orderBy(F.desc(score), tie)
    return ranked.withColumn("_at", F.row_number().over(best)).where("_at = 1").drop("_at")


def sunk(ranked: DataFrame, low: Column, score: str, tie: str, k: int, by: tuple[str, ...]) -> DataFrame:
    """``k`` rows of each ``by`` in order, those marked ``low`` after all others, with ``rank`` from 0."""
    order = Window.partitionBy(*by).orderBy(low.cast("int"), F.desc(score), tie)
    return ranked.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def reordered(queries: DataFrame, given: DataFrame, ranked: DataFrame) -> DataFrame:
    """``query_id, id, rank`` (from 0): a given set (``id``) anew for each of ``queries`` (``id``), first what ``ranked``
    (``query_id, id, rank``, of members of the set alone) has of it, in order, the rest by id; none holds the query itself.

    A member's rank follows from its place in the set and from the few that are ranked, so
    blocks of queries meet blocks of the set, and no pair is sorted or shuffled."""
    given, queries = cut(placed(given.where("id is not null").distinct(), [], ["id"])), queries.where("id is not null").distinct()
    lists = ranked.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("k"), F.col("id").alias("it")))).alias("first"))
    asked = queries.join(given.select("id", F.lit(True).alias("own")), "id", "left").join(lists, "id", "left").select("id", F.coalesce("own", F.lit(False)).alias("own"), F.col("first.it").alias("first"))
    n, m = (max(1, -(-df.count() // size)) for df, size in ((queries, ASKED), (given, HELD)))

    def members(rows: pa.Table) -> tuple:
        rows = rows.sort_by("id")
        return rows.column("id").to_numpy(), rows.column("place").to_numpy()

    def each(rows: pa.Table) -> list:
        out = []
        for name, own, first in zip(*(rows.column(c).to_pylist() for c in ("id", "own", "first")), strict=True):
            first = np.array(first or [], np.int64)
            out.append((name, first, np.sort(np.r_[first, [name] * own]).astype(np.int64), np.argsort(first, kind="stable")))
        return out

    def task(mine, others):
        for _, (ids, place) in others:
            out = []
            for name, first, gone, order in mine[1]:
                rank = len(first) + place - np.searchsorted(gone, ids)
                at = np.searchsorted(ids, first[order])
                there = at < len(ids)
                there[there] = ids[at[there]] == first[order][there]
                rank[at[there]] = order[there]
                other = ids != name
                out.append((np.full(int(other.sum()), name), ids[other], rank[other]))
                if len(out) == SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names, types = ["query_id", "id", "rank"], [pa.int64(), pa.int64(), pa.int32()]
    return crossed(packed(asked, n, each), packed(given.select("id", "place"), m, members), (n, m), task, "query_id long, id long, rank int")


def confidence(rank: Column, cosine: Column, proximity: Column | None = None) -> Column:
    """1 / (1 + rank), raised by the cosine and by a link, each by a share of what is left to 1."""
    base = 1.0 / (1 + F.greatest(rank, F.lit(0)))
    strength = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - 0.55) / (0.85 - 0.55))), F.lit(0.0))
    score = base + (1 - base) * 0.35 * strength
    if proximity is not None:
        score = score + (1 - score) * 0.15 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), proximity))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def prominence(score: Column) -> Column:
    return F.when(score >= 0.6, "prominent").when(score >= 0.3, "quiet").otherwise("faint")


def linked_signal(links: Column) -> Column:
    return F.least(F.lit(1.0), F.log2(1 + F.greatest(links, F.lit(0)).cast("double")) / 4)


def recency_signal(age_days: Column) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / 30)


def atomicity_signal(chunks: Column) -> Column:
    return F.least(F.lit(1.0), 3.0 / F.greatest(chunks, F.lit(1)))


def calibrated(raw: Column, knots: tuple[tuple[float, float], ...] = KNOTS) -> Column:
    """Raw cosines on the scale of the thresholds: linear between knots, shifted beyond them."""
    (x0, y0), (x1, y1) = knots[0], knots[-1]
    out = F.when(raw <= x0, raw + (y0 - x0)).when(raw >= x1, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), raw + (y1 - x1))))
    for (a, c), (b, d) in zip(knots, knots[1:], strict=False):
        out = out.when(raw <= b, c + (raw - a) / (b - a) * (d - c))
    return out


def raw_of(threshold: Column, knots: tuple[tuple[float, float], ...] = KNOTS) -> Column:
    """The inverse of ``calibrated``, to compare raw cosines with a threshold."""
    return calibrated(threshold, tuple((y, x) for x, y in knots))


def band(cosine: Column, candidate: float, echo: float, linked: Column) -> Column:
    """``echo`` from the upper floor on unless linked, ``candidate`` between the floors."""
    return F.when((cosine >= echo) & ~linked, "echo").when((cosine >= candidate) & (cosine < echo), "candidate")


def echo_confidence(cosine: Column, floor: float) -> Column:
    return 0.5 + 0.4 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cosine - floor) / (1 - floor)))
