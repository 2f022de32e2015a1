"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source, targets are filled like water under each source's cap,
and a document of a source with repetition rate r is taken floor(r) times plus once
more with probability r - floor(r), by a hash of its id: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.lineage import cut

#: Sources that may travel to the documents; more are joined by a shuffle.
FEW_SOURCES = 20_000
#: Weights by place in the order of sources, repeated.
WEIGHTS = (3, 1, 2)


def words(text: Column) -> Column:
    """Runs outside 0x20 and 0x09-0x0D in a text; null has none.

    With every run of separators made one space, it is the count of spaces less the
    one that may stand at either end."""
    flat = F.trim(F.regexp_replace(text.cast("string"), "[\\x20\\x09-\\x0D]+", " "))
    return F.coalesce(F.when(F.length(flat) > 0, F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1), F.lit(0)).cast("long")


def _placed(sources: DataFrame) -> DataFrame:
    """``place``, counted from 0 over all sources by code point, null last, without one task for all."""
    rows = cut(sources.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    # as many rows as partitions of the sort
    before = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return rows.join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part").select("source", "source_size", (F.col("at") + F.col("before")).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, cap: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    The sources share ``total`` times all words by weight; none gets over ``cap`` times its
    own, and the excess is shared among the rest by weight until none is above. Only
    sums of all sources come to the driver, once for each round.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    rows = cut(_placed(sizes).withColumn("weight", weight).withColumn("limit", F.col("source_size") * cap))
    everything = rows.agg(F.sum("source_size")).first()[0] or 0
    num, den, full = 2 * everything * total, 2, -1  # a target is weight * num / den
    while True:
        # weight * share > limit, in whole numbers where total is a multiple of a half
        over = F.col("weight") * F.lit(num) > F.col("limit") * F.lit(float(den)) if full >= 0 else F.lit(False)
        held, rest, n = rows.agg(F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == full or not rest:
            break
        full = n
        num, den = 2 * everything * total - 2 * (held or 0), 2 * rest
    target = F.when(over, F.col("limit").cast("double")).otherwise(F.col("weight") * F.lit(float(num)) / F.lit(float(den)))
    return rows.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), ``size, source_size, target, copies``.

    A null source is a source of its own, last in order. Documents without words, or
    of sources without, aren't taken. Repeated rows are taken alike; a null doc_id is
    hashed with its text. An empty table gives an empty result.
    """
    sized = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"))
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = cut(targets(sums, weights, total, cap)).toDF("of", "source_size", "target")
    goal = F.broadcast(goal) if goal.count() <= FEW_SOURCES else goal
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    name = F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("n"), F.md5(text)))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    copies = F.when(F.col("size") > 0, (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")).otherwise(0)
    return sized.join(goal, F.col("source").eqNullSafe(F.col("of")), "left").select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns as they were."""
    rows = mixed(docs, **options).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken`` (words, repeats counted)."""
    rows = mixed(docs.select("doc_id", "source", "text"), **options)
    return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB SQL with the rows of ``mix_report(documents)``.
REPORT_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s
), r AS (
  SELECT *, 2.0 * source_size / weight AS ratio FROM p
), c AS (
  SELECT *, coalesce(sum(2 * source_size) OVER before, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest, sum(source_size) OVER () AS everything
  FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT CAST(3 * everything - 2 * held AS DOUBLE) AS num, CAST(2 * rest AS DOUBLE) AS den
  FROM c WHERE weight * (3 * everything - 2 * held) <= 2 * source_size * (2 * rest) ORDER BY ratio, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN l.num IS NULL OR weight * l.num > 2 * source_size * l.den THEN CAST(2 * source_size AS DOUBLE) ELSE weight * l.num / l.den END AS target
  FROM p LEFT JOIN l ON TRUE
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'n' || md5(coalesce(d.text, '')))), 1, 8)) AS BIGINT) / 4294967296.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 THEN floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END ELSE 0 END * size AS BIGINT) AS taken
FROM x
"""
