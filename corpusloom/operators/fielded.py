"""Lexical search over several fields: each has lengths, counts and a weight of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.lexical import B, K1, TOKEN, few, fuzzy, prefixed

# How much a field counts.
BOOSTS = {"title": 2.0, "meta": 2.0, "heading": 1.5, "text": 1.0}
# What a term counts that an asked one is a prefix of, or within edits of, and how fast that falls with the letters between them.
PREFIX, FALL, EDIT = 0.375, 0.3, 0.45


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _cells(units: DataFrame, fields: list[str], key: str) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(c).alias("field"), _tokens(F.col(c)).alias("terms")) for c in fields))
    rows = units.select(F.col(key).alias("id"), F.explode(cells).alias("c")).select("id", "c.field", "c.terms", F.size("c.terms").alias("len"))
    return rows.where("len > 0")


def postings(units: DataFrame, fields: list[str], key: str = "id", only: DataFrame | None = None) -> DataFrame:
    """``id, field, term, tf, len``: counts of each field's terms and the field's length; with ``only`` (``term``), of these alone.

    An empty or null field has no rows; counts are taken within a task before anything is shuffled."""
    words = _cells(units, fields, key).select("id", "field", "len", F.explode("terms").alias("term"))
    if only is not None:
        words = words.join(few(only.select("term").distinct()), "term", "left_semi")
    return words.groupBy("id", "field", "len", "term").agg(F.count("*").cast("double").alias("tf")).select("id", "field", "term", "tf", "len")


def statistics(units: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """``field, docs, mean``: how many units have a field, and its mean length there; a row for each field."""
    return _cells(units, fields, key).groupBy("field").agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))


def vocabulary(units: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    return _cells(units, fields, key).select(F.explode("terms").alias("term")).distinct()


def weighted(words: DataFrame, terms: DataFrame, share: float | None = 0.2) -> DataFrame:
    """``query_id, asked, term, weight``: each asked term itself, met or not, terms of ``words`` that it is a prefix of, and those
    within an edit distance of ``share`` of its length; the greatest weight of each."""
    n = F.length("asked")
    rows = terms.select("query_id", F.col("term").alias("asked"), "term", F.lit(1.0).alias("weight"))
    longer = prefixed(words, terms).where("term <> asked")
    rows = rows.unionByName(longer.withColumn("weight", PREFIX * n / (n + FALL * (F.length("term") - n))))
    if share is not None:
        near = fuzzy(words, terms, share).where("distance > 0")
        rows = rows.unionByName(near.select("query_id", "asked", "term", (EDIT * n / (n + F.col("distance"))).alias("weight")))
    return rows.groupBy("query_id", "asked", "term").agg(F.max("weight").alias("weight"))


def field_scores(index: DataFrame, stats: DataFrame, terms: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """``query_id, id, field, score, asked``: what each field of a unit adds to a query, and the asked terms it meets."""
    hits = index.join(terms, "term")
    df = index.groupBy("field", "term").agg(F.count("*").alias("df"))
    boost = F.element_at(F.create_map(*(F.lit(x) for kv in boosts.items() for x in kv)), F.col("field"))
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    # a row for each field
    scored = hits.join(df, ["field", "term"]).join(F.broadcast(stats), "field")
    return scored.groupBy("query_id", "id", "field").agg(F.sum(part).alias("score"), F.collect_set("asked").alias("asked"))


def search(units: DataFrame, terms: DataFrame, k: int, boosts: dict[str, float] | None = None, every: bool = True, key: str = "id", keep=None) -> DataFrame:
    """``query_id, id, score, rank`` (from 0), and ``by_field``: the k best units of each query.

    ``terms`` are as from ``weighted``. With ``every``, each asked term must be met in some field, and one that nothing
    stands for lets nothing through. ``keep`` takes ``query_id, id`` rows and leaves those that may
    be found, so filters apply before anything is ranked. Scores are rounded to 6 digits, ties go to the smaller id.
    """
    boosts = boosts or BOOSTS
    fields = list(boosts)
    index = postings(units, fields, key, terms)
    scores = field_scores(index, statistics(units, fields, key), terms, boosts)
    if keep is not None:
        scores = keep(scores)
    found = scores.groupBy("query_id", "id").agg(
        F.round(F.sum("score"), 6).alias("score"),
        F.size(F.array_distinct(F.flatten(F.collect_list("asked")))).alias("met"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.round("score", 6).alias("score"))))).alias("by_field"),
    )
    if every:
        needed = terms.groupBy("query_id").agg(F.countDistinct("asked").alias("needed"))
        found = found.join(needed, "query_id").where("met = needed")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("query_id", "id", "score", "rank", "by_field")
