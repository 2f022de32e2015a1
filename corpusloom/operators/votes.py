"""Votes, tallies and clusters over long-form tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import predicates as P
from corpusloom.operators.crossing import crossed, packed
from corpusloom.operators.graph import connected_components
from corpusloom.sources.lineage import cut, tallied

#: Nodes and links in a task's block, pairs marked at a time, and rows of an Arrow batch.
HOP_NODES, HOP_LINKS, HOP_PAIRS, HOP_ROWS = 4096, 500_000, 4_000_000, 50_000


def wanted_topics(links: DataFrame, published: DataFrame, k: int = 3, referrers: int = 12) -> DataFrame:
    """The most wanted targets of unresolved links ``src, dst, n``.

    Fragments and aliases go, dated names too; a source counts once. ``published`` has the
    ``src`` whose demand is public, counted among a target's first referrers only. Kept are
    targets of two sources or with public demand.
    """
    title = F.trim(F.regexp_extract("dst", r"^([^#|]*)", 1))
    per = links.select("src", title.alias("title"), "n").where((F.col("title") != "") & ~P.looks_periodic(F.col("title"))).groupBy("src", "title").agg(F.sum("n").alias("n"))
    totals = per.groupBy("title").agg(F.count("*").alias("sources"), F.sum("n").alias("refs"))
    first = per.withColumn("k", F.row_number().over(Window.partitionBy("title").orderBy("src"))).where(F.col("k") <= referrers)
    public = first.join(published.select("src").distinct(), "src", "left_semi").groupBy("title").agg(F.count("*").alias("public_demand"))
    rows = totals.join(public, "title", "left").withColumn("public_demand", F.coalesce("public_demand", F.lit(0)))
    rows = rows.where("sources >= 2 or public_demand > 0")
    return rows.orderBy(F.desc("public_demand"), F.desc("sources"), F.desc("refs"), "title").limit(k)


def suggest_tags(votes: DataFrame, k: int = 3) -> DataFrame:
    """The k best ``tag`` of each ``entry`` from ``entry, tag, cosine``: by summed cosine (0.5 where
    missing), if two neighbours have the tag or one is very near. With ``sources`` a row sums up so many votes."""
    many = F.sum("sources") if "sources" in votes.columns else F.count("*")
    n = votes.groupBy("entry", F.lower("tag").alias("tag")).agg(F.round(F.sum(F.coalesce("cosine", F.lit(0.5))), 6).alias("weight"), many.alias("sources"))
    n = n.where("sources >= 2 or weight >= 0.85")
    by = Window.partitionBy("entry").orderBy(F.desc("weight"), "tag")
    return n.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def placement(votes: DataFrame) -> DataFrame:
    """``entry, folder`` from ``entry, folder, weight``: the deepest folder with more than half of all weight.

    Round by round every voter moves to its parent; the round in which a folder first has a
    majority is the number of steps its voters have taken, so all rounds are one grouping
    of (steps, folder). The root never wins, and one voter is not enough.
    """
    total = votes.groupBy("entry").agg(F.sum("weight").alias("total"), F.count("*").alias("voters")).where("voters >= 2 and total > 0")
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    deepest = votes.withColumn("parts", parts)
    steps = deepest.select("entry", "weight", "parts", F.explode(F.sequence(F.lit(0), F.greatest(F.size("parts") - 1, F.lit(0)))).alias("step"))
    at = steps.select("entry", "weight", "step", F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - F.col("step"), F.lit(0))), "/").alias("folder"))
    share = at.groupBy("entry", "step", "folder").agg(F.sum("weight").alias("weight")).join(total, "entry").where("folder <> '' and weight > total / 2")
    return share.groupBy("entry").agg(F.min_by("folder", "step").alias("folder"))


def affinity(neighbours: DataFrame) -> DataFrame:
    """``entry, affinity``: the journal share of all cosines of ``entry, cosine, journal``; 0 if there are none."""
    s = F.sum("cosine")
    return neighbours.groupBy("entry").agg(F.when(s > 0, F.sum(F.when(F.col("journal"), F.col("cosine")).otherwise(0.0)) / s).otherwise(0.0).alias("affinity"))


def themes(edges: DataFrame, covered: DataFrame, least: int = 3, cover: float = 0.75) -> DataFrame:
    """``component, size``: components of at least ``least`` entries none of which a permanent note covers.

    ``edges`` has ``src, dst``; ``covered`` has ``node, cosine``, each entry's best permanent note."""
    comp = connected_components(edges)
    best = comp.join(covered, "node", "left").groupBy("component").agg(F.count("*").alias("size"), F.max("cosine").alias("best"))
    return best.where((F.col("size") >= least) & (F.coalesce("best", F.lit(0.0)) < cover)).select("component", "size")


def theme_evidence(hits: DataFrame, permanent: DataFrame, near: float, least: int = 3, cover: float = 0.75, most: int = 4, joined: DataFrame | None = None) -> DataFrame:
    """``component, size, best, evidence``: themes as in ``themes``, with what they say.

    ``hits`` has ``src, dst, cosine, snippet``: what each dated entry found among dated ones, from both
    sides; those at ``near`` or over make components. ``permanent`` has ``node, cosine``: hits among permanent notes, of which the
    best must stay under ``cover``. Evidence is at most ``most`` different snippets of hits, nearest first. With ``joined`` (``src, dst``), which
    makes the components, hits need hold no more than the nearest of each ``dst``.
    """
    edges = hits.where(F.col("cosine") >= near)
    comp = cut(connected_components((edges if joined is None else joined).select("src", "dst")))
    best = permanent.groupBy("node").agg(F.max("cosine").alias("cosine"))
    kept = comp.join(best, "node", "left").groupBy("component").agg(F.count("*").alias("size"), F.coalesce(F.max("cosine"), F.lit(0.0)).alias("best"))
    kept = kept.where((F.col("size") >= least) & (F.col("best") < cover))
    said = edges.join(comp.withColumnRenamed("node", "src"), "src").groupBy("component", "snippet").agg(F.max("cosine").alias("cosine"))
    first = said.withColumn("_k", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("cosine"), "snippet"))).where(F.col("_k") <= most)
    evidence = first.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "snippet"))), lambda x: x.snippet).alias("evidence"))
    return kept.join(evidence, "component").select("component", "size", "best", "evidence")


def weave(edges: DataFrame, woven: DataFrame) -> DataFrame:
    """``thread, entry, cosine``: entries outside every thread with an edge into one; ``woven`` has ``thread, entry``."""
    both = edges.select("src", "dst", "cosine").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cosine"))
    into = both.join(woven.select("thread", F.col("entry").alias("dst")), "dst").join(woven.select(F.col("entry").alias("src")).distinct(), "src", "left_anti")
    return into.groupBy("thread", F.col("src").alias("entry")).agg(F.max("cosine").alias("cosine"))


def backlinks(links: DataFrame) -> DataFrame:
    """``dst, sources, refs`` from ``src, dst, n``."""
    return links.groupBy("dst").agg(F.count_distinct("src").alias("sources"), F.sum("n").alias("refs"))


def two_hop(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``node, near``: what lies one or two links from each node (of ``start``, or all), in either
    direction.

    Nodes are dealt into blocks with all their links. A block of nodes meets every block of what may be near, and a pair is
    marked in a table of the two however many links lead there, so pairs are neither shuffled nor counted twice."""
    both = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(links.select(F.col("dst").alias("a"), F.col("src").alias("b"))).where("a is not null and b is not null").distinct()
    # numbers stand for nodes between two others
    numbered, nodes = tallied(both.select("a").distinct())
    numbered = numbered.withColumn("i", F.monotonically_increasing_id())
    ends, (pairs,) = tallied(both.join(numbered, "a").join(numbered.toDF("b", "j"), "b").select("a", "i", "j"))
    many = max(1, -(-nodes[0] // HOP_NODES), -(-pairs // HOP_LINKS))
    held = packed(ends, many, _linked, "i")
    asked = held if start is None else packed(ends.join(start.select(F.col("node").alias("a")).distinct(), "a", "left_semi"), many, _linked, "i")
    kind = both.schema["a"].dataType.simpleString()
    return crossed(asked, held, (many, many), _near, f"node {kind}, near {kind}")


def _linked(rows: pa.Table):
    """The nodes of a block, their numbers in order, and their links: the place of one end, the number of the other."""
    node, first = np.unique(rows.column("i").to_numpy(), return_index=True)
    at = np.searchsorted(node, rows.column("i").to_numpy())
    end = rows.column("j").to_numpy()
    order = np.argsort(end, kind="stable")
    return rows.column("a").combine_chunks().take(pa.array(first)), node, at[order], end[order]


def _near(asked, blocks):
    names, numbers, at, end = asked[1]
    for _, (others, other, to, through) in blocks:
        seen = np.zeros((len(numbers), len(other)), bool)
        # one link away
        k = np.minimum(np.searchsorted(other, end), len(other) - 1)
        hit = other[k] == end
        seen[at[hit], k[hit]] = True
        # two: every link with all that lead on from its end, some at a time
        lo, hi = np.searchsorted(through, end, "left"), np.searchsorted(through, end, "right")
        upto = np.cumsum(hi - lo)
        a = 0
        while a < len(end):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HOP_PAIRS, "right")))
            n = (hi - lo)[a:b]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seen[np.repeat(at[a:b], n), to[np.repeat(lo[a:b], n) + step]] = True
            a = b
        k = np.minimum(np.searchsorted(other, numbers), len(other) - 1)
        seen[np.flatnonzero(other[k] == numbers), k[other[k] == numbers]] = False
        i, j = np.nonzero(seen)
        for k in range(0, len(i), HOP_ROWS):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i[k : k + HOP_ROWS])), others.take(pa.array(j[k : k + HOP_ROWS]))], ["node", "near"])


def distinguishing(rows: DataFrame, group: str, key: str, properties: list[str]) -> DataFrame:
    """``group, key, property, value`` for the properties whose values differ within a group; null counts as empty."""
    pairs = F.array(*(F.struct(F.lit(p).alias("property"), F.coalesce(F.col(p).cast("string"), F.lit("")).alias("value")) for p in properties))
    long = rows.select(group, key, F.explode(pairs).alias("p")).select(group, key, "p.*")
    differ = long.groupBy(group, "property").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select(group, "property")
    return long.join(differ, [group, "property"], "left_semi")


def rank_fill_out(notes: DataFrame, k: int = 2) -> DataFrame:
    """The k most incomplete notes of ``title, score, published``: published first."""
    return notes.where("score > 0").orderBy(F.desc("published"), F.desc("score"), "title").limit(k)
