"""Near-duplicates by bottom-k sketches of one hash function.

Each text's set of word shingles keeps its ``SKETCH`` least hashes. Rows with equal
sets form one class, which goes on under a number of its own. Inverted lists of the retained
values make candidates: a text is listed under its rarest values only, as many as any
partner must meet (``SHARED`` in common). The sketch of the union then estimates each
candidate's similarity, and the full sets confirm it.

A list of at most ``SHORT`` texts gives all its pairs. The texts of longer lists are
listed anew by the rarest members of their full sets (an exact prefix filter); lists
that stay long first link to their most central text, and only texts that still lie
in different components are then paired. No list is cut and no pair is dropped.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.blocks import by_task, mix, shingles, words
from corpusloom.operators.graph import connected_components
from corpusloom.sources.lineage import cut, tallied

#: Retained values of a text.
SKETCH = 32
#: Retained values that two linked texts share at least: at similarity 0.85 fewer are
#: shared with a probability under 1e-8, at 0.8 under 2e-6.
SHARED = 14
#: Texts in a list whose pairs are all made.
SHORT = 32
#: The estimate may fall this far below the threshold (over 6 standard errors).
SLACK = 0.4
#: Ids that may travel to every task: 16 MB, with the hashes of their sets 48 MB.
FEW = 1_000_000
#: Pairs of one class that a task reads; those of a class with more are dealt over several.
HOT = 128
#: Pairs, sketches or tenths of numbers in a task that writes for a shuffle: files of a block each, of one task and table, would fill the disk.
TASK = 20_000
_SIGN = np.uint64(1 << 63)  # keeps the unsigned order
_SETS = "doc_id long, text_hash long, n long, a long, b long, sketch array<long>"


def _tasks(rows: int) -> int:
    """Tasks for so many rows, in proportion; two at least, so that joins still deal them out."""
    return 2 + rows // TASK


def _sets(width: int, whole: bool):
    def run(batches):
        for batch in batches:
            w, at = words(batch.column(1))
            ids, rows = batch.column(0).to_pylist(), []
            for i, doc in enumerate(ids):
                s = shingles(w[at[i] : at[i + 1]], width)
                a, b = (int(mix(s, k).sum(dtype=np.uint64).view(np.int64)) for k in (11, 12))
                rows.append((doc, len(s), a, b, ((s if whole else s[:SKETCH]) ^ _SIGN).view(np.int64)))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *(len(r[4]) for r in rows)]).astype(np.int32), np.concatenate([r[4] for r in rows]) if rows else np.zeros(0, np.int64))
            numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([numbers[0], batch.column(2), *numbers[1:], lists], ["doc_id", "text_hash", "n", "a", "b", "sketch"])

    return run


def shingle_sets(docs: DataFrame, width: int = 5, whole: bool = False) -> DataFrame:
    """``doc_id, text_hash, n, a, b, sketch``: a hash of the text, set size, a 128-bit hash of
    the set, and its least ``SKETCH`` hashes in unsigned order (with ``whole``, all of them)."""
    by_task(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string"))).mapInArrow(_sets(width, whole), _SETS)


def _prefix(rows: DataFrame, needed: str, tasks: int) -> DataFrame:
    """``doc, value, size, alone``: of ``doc, value, size``, the rarest values of each doc,
    so many that two docs with ``needed`` values in common meet in one. Values of one doc
    only meet nobody; ``alone`` counts them."""
    often = rows.groupBy("value").agg(F.count("*").alias("often")).where("often > 1")
    by = Window.partitionBy("doc")
    shared = rows.join(often, "value").coalesce(tasks).withColumn("alone", F.col("size") - F.count("*").over(by))
    ranked = shared.withColumn("at", F.col("alone") + F.row_number().over(by.orderBy("often", "value")))
    return ranked.where(f"at <= size - ({needed}) + 1").select("doc", "value", "size", "alone", "at").coalesce(tasks)


def _listed(rows: DataFrame, tasks: int) -> tuple[DataFrame, int, DataFrame | None]:
    """Pairs of the short lists and tasks for them, and the rows of the long ones, if there are any."""
    lists = rows.groupBy("value").agg(F.count("*").alias("len")).where("len > 1")
    rows, (n, longer) = tallied(rows.join(lists, "value").coalesce(tasks), F.count(F.lit(1)), F.count_if(F.col("len") > SHORT))
    few = _tasks(n)
    rows = rows.coalesce(few)
    short = rows.where(f"len <= {SHORT}").select("value", "doc")
    pairs = short.join(short.withColumnRenamed("doc", "other"), "value").where("doc < other").select("doc", "other").coalesce(few).distinct().coalesce(few)
    return pairs, few, rows.where(f"len > {SHORT}").drop("len") if longer else None


def _dealt(rows: DataFrame) -> DataFrame:
    """For joins by class, which deal both sides out: a small side doesn't travel through the driver, where each such table takes megabytes."""
    return rows.hint("merge")


def _with_sets(pairs: DataFrame, side: str, sets: DataFrame, tasks: int) -> DataFrame:
    """Pairs with the columns of one side's class; a class of many pairs, such as the text that
    a long list is compared with, is copied to several tasks that share its pairs."""
    hot, (n,) = tallied(pairs.groupBy(side).agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1").coalesce(tasks))
    if not n:
        return pairs.join(_dealt(sets), side)
    hot = F.broadcast(hot) if n <= FEW else hot
    part = F.pmod(F.xxhash64("doc", "other"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pairs.join(hot, side, "left").withColumn("part", part).drop("parts")
    copies = sets.join(hot, side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(_dealt(copies), [side, "part"]).drop("part")


def _both(pairs: DataFrame, sets: DataFrame, values: str, tasks: int, hot: bool) -> DataFrame:
    """Pairs with ``n1, s1`` and ``n2, s2`` of their classes; ``hot`` if a class may have any number of pairs."""
    for side, names in (("doc", ("n1", "s1")), ("other", ("n2", "s2"))):
        of = sets.select("id", "n", values).toDF(side, *names)
        pairs = (_with_sets(pairs, side, of, tasks) if hot else pairs.join(_dealt(of), side)).coalesce(tasks)
    return pairs


def _likely(pairs: DataFrame, sets: DataFrame, percent: int, tasks: int, hot: bool = False) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose union sketch doesn't refute it."""
    p = _both(pairs, sets, "sketch", tasks, hot).where(f"100 * least(n1, n2) >= {percent} * greatest(n1, n2)")
    p = p.withColumn("low", F.slice(F.array_sort(F.array_union("s1", "s2")), 1, SKETCH))
    both = F.size(F.array_intersect(F.array_intersect("low", "s1"), F.col("s2")))
    return p.where(both >= F.size("low") * (percent / 100 - SLACK)).select("doc", "other")


def _full(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int, tasks: int) -> tuple[DataFrame, int]:
    """``id, n, s``: the whole shingle sets of the named classes, from the texts of their least doc_ids, and tasks for their members.

    Few ids travel to the texts, else both are dealt out. A doc_id may have other texts
    too, so sets are told by their hashes."""
    asked, (n,) = tallied(classes.join(_dealt(ids), "id", "left_semi").select("id", F.col("least").alias("doc_id"), "n", "a", "b").coalesce(tasks))
    near = F.broadcast if n <= FEW else lambda x: x
    some = docs.join(near(asked.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = shingle_sets(some, width, True).select("n", "a", "b", F.col("sketch").alias("s"))
    full, (members,) = tallied(sets.join(near(asked.drop("doc_id")), ["n", "a", "b"]).select("id", "n", "s").dropDuplicates(["id"]), F.sum("n"))
    few = _tasks((members or 0) // 10)
    return full.coalesce(few), few


def _confirm(pairs: DataFrame, full: DataFrame, percent: int, tasks: int, hot: bool = False) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, by full sets."""
    both = F.size(F.array_intersect("s1", "s2")).cast("long")
    return _both(pairs, full, "s", tasks, hot).withColumn("both", both).where(f"100 * both >= {percent} * (n1 + n2 - both)").select("doc", "other")


def _ids(*columns: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (c.toDF("id") for c in columns)).distinct()


def _long_lists(rows: DataFrame, docs: DataFrame, sets: DataFrame, links: DataFrame, percent: int, width: int, tasks: int) -> DataFrame:
    """``links`` and all that the texts of long lists add to the components."""
    full, few = _full(docs, sets, _ids(rows.select("doc")), width, tasks)
    members = full.select(F.col("id").alias("doc"), F.col("n").cast("long").alias("size"), F.explode("s").alias("value"))
    pairs, some, rest = _listed(_prefix(members, f"cast(ceil({percent} * size / 100) as bigint)", few), few)
    links = cut(links.unionByName(_confirm(_likely(pairs, sets, percent, some), full, percent, some)))
    if rest is None:
        return links
    # two sets can't share more than what either has besides values of its own alone
    allowed = f"least(a.size - a.alone, b.size - b.alone) * (100 + {percent}) >= {percent} * (a.size + b.size) and a.doc <> b.doc"

    def more(a: DataFrame, b: DataFrame, also: str) -> DataFrame:
        met = a.alias("a").join(b.alias("b"), F.expr(f"a.value = b.value and {allowed}{also}")).select(F.least("a.doc", "b.doc").alias("doc"), F.greatest("a.doc", "b.doc").alias("other")).distinct()
        met, (n,) = tallied(met)
        n = _tasks(n)
        return cut(links.unionByName(_confirm(cut(_likely(met.coalesce(n), sets, percent, n, True)), full, percent, n, True)))

    # first a star around each list's most central text, that with the least part of its own
    centre = rest.groupBy("value").agg(F.min(F.struct((F.col("alone") / F.col("size")).alias("share"), "doc", "size", "alone")).alias("c")).select("value", "c.*")
    links = more(rest, centre, "")
    # then, pair by pair, whatever still lies outside the largest component of its list:
    # each pair in the list of its first common value, before which the two share nothing
    comp = connected_components(links, "doc", "other").toDF("doc", "comp")
    every = rest.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x.value).alias("values"))
    at = cut(rest.join(_dealt(every), "doc").join(_dealt(comp), "doc", "left").withColumn("comp", F.coalesce("comp", "doc")).coalesce(some))
    top = at.groupBy("value", "comp").agg(F.count("*").alias("k")).groupBy("value").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    at = at.join(top.select("value", F.col("top.comp").alias("main")), "value")
    also = f" and a.comp <> b.comp and (b.comp = b.main or a.doc < b.doc) and least(a.size - a.at, b.size - b.at) + 1 >= {percent} * (a.size + b.size) / (100 + {percent}) and a.value = element_at(array_intersect(a.values, b.values), 1)"
    return more(at.where("comp <> main"), at, also)


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` for each row of ``docs``.

    Texts whose shingle sets have 100 * intersection >= ``percent`` * union (80 or
    more) are linked; ``component_id`` is the least doc_id reachable. Texts that are
    null, empty or without words have an empty set and are linked with nothing; rows
    without a doc_id are kept, with a null component. Repeated rows come back as often
    as they come in, and rows of one doc_id with different texts are linked each by its
    own; other columns don't matter; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    every, (n,) = tallied(shingle_sets(docs, width))
    tasks = _tasks(n)
    every = every.coalesce(tasks)
    live = every.where("n > 0 and doc_id is not null")
    classes = cut(live.groupBy("n", "a", "b").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch")).coalesce(tasks).withColumn("id", F.monotonically_increasing_id()))
    values = classes.select(F.col("id").alias("doc"), F.size("sketch").cast("long").alias("size"), F.explode("sketch").alias("value"))
    # texts of few shingles are retained whole, so their share can be told from their size
    pairs, few, rest = _listed(_prefix(values, f"least({SHARED}, cast(ceil({percent} * size / 100) as bigint))", 3 * tasks), 3 * tasks)
    pairs = cut(_likely(pairs, classes, percent, few))
    full, _ = _full(docs, classes, _ids(pairs.select("doc"), pairs.select("other")), width, tasks)
    links = cut(_confirm(pairs, full, percent, few))
    if rest is not None:
        links = _long_lists(rest, docs, classes, links, percent, width, tasks)
    comp = connected_components(links, "doc", "other").toDF("id", "comp").join(_dealt(classes.select("id", "least")), "id").coalesce(tasks)
    comp = comp.join(comp.groupBy("comp").agg(F.min("least").alias("component")), "comp").select("id", "component").coalesce(tasks)
    named = classes.join(_dealt(comp), "id", "left").select("n", "a", "b", F.coalesce("component", "least").alias("component")).coalesce(tasks)
    rows = every.select("doc_id", "text_hash", "n", "a", "b").join(named, ["n", "a", "b"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def near_dedup(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near-duplicates, that of
    the least doc_id; columns as they were.

    Rows without a doc_id, and rows whose text is null, empty or without words, all stay;
    a repeated row stays as often as it comes in; of a doc_id with several texts only the
    rows go whose text is another document's near-duplicate; an empty table stays empty.
    """
    gone, (n,) = tallied(near_duplicates(docs, percent, width).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct())
    # few ids travel to the texts; many are met by dealing out both
    gone = F.broadcast(gone) if n <= FEW else gone
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_hash"]), "left_anti")
