"""How well similarity finds what notes link to: ranks of true targets, counted in blocks.

A note's score for another is the best cosine of any two of their chunks. The rank of a link's target is
one more than the notes that score higher, so no ranking is made: all chunks of a note
are in one block, blocks of notes meet blocks of notes, first for the scores of the links
alone, then to count what is above them. A row for each link leaves a task, not one for each pair, and no chunk is copied in a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.crossing import crossed, packed
from corpusloom.sources.lineage import cut

#: Chunks in a task's block, but that a note's stay together, and chunks compared at a time.
BLOCK, AT_ONCE = 4096, 256


def _notes(rows: pa.Table, *more: str) -> tuple:
    """The notes of a block in order, where the chunks of each begin, all chunks at length one, and of each note ``more``."""
    rows = rows.sort_by("note")
    v = rows.column("v").combine_chunks()
    m = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
    less = m.astype(np.float32)
    notes, first = np.unique(rows.column("note").to_numpy(), return_index=True)
    return notes, first, less if (less == m).all() else m, *(rows.column(c).take(pa.array(first)).to_pylist() for c in more)


def _normed(m: np.ndarray) -> np.ndarray:
    m = m.astype(float)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def _held(rows: pa.Table) -> tuple:
    notes, first, m, may = _notes(rows, "eligible")
    return notes, first, m, np.array(may, bool)


def _asked(*names: str):
    """Notes with their links: ``src, first, chunks``, and of each link the place of its note and ``names``."""

    def make(rows: pa.Table) -> tuple:
        notes, first, m, targets = _notes(rows, "targets")
        at = np.repeat(np.arange(len(notes)), [len(t) for t in targets])
        return notes, first, m, at, *(np.array([t[c] for x in targets for t in x]) for c in names)

    return make


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _score(mine, others):
    src, first, a, at, dst = mine[1]
    a, ends = _normed(a), np.append(first, len(a))[1:]
    for _, (notes, begin, b, may) in others:
        k = np.minimum(np.searchsorted(notes, dst), len(notes) - 1)
        there = np.flatnonzero((notes[k] == dst) & may[k])
        b, stop = _normed(b), np.append(begin, len(b))[1:]
        score = [np.round(a[first[at[i]] : ends[at[i]]] @ b[begin[k[i]] : stop[k[i]]].T, 6).max() for i in there]
        yield _batch(src=src[at[there]], dst=dst[there], score=np.array(score, float))


def _above(mine, others):
    src, first, a, at, dst, score = mine[1]
    a, above = _normed(a), np.zeros(len(dst), np.int64)
    # whole notes, of so many chunks together
    cuts = np.append(np.flatnonzero(np.r_[True, first[1:] // AT_ONCE != first[:-1] // AT_ONCE]), len(src))
    for _, (notes, begin, b, may) in others:
        b = _normed(b)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            rows = slice(first[lo], first[hi] if hi < len(src) else len(a))
            part = a[rows]
            best = np.concatenate([np.maximum.reduceat(np.round(part[k : k + AT_ONCE] @ b.T, 6), begin, axis=1) for k in range(0, len(part), AT_ONCE)])
            best = np.maximum.reduceat(best, first[lo:hi] - first[lo], axis=0)
            best[:, ~may] = -2
            links = np.flatnonzero((at >= lo) & (at < hi))
            # neither the note itself nor the target counts
            for k in range(0, len(links), AT_ONCE):
                i = links[k : k + AT_ONCE]
                higher = best[at[i] - lo] > score[i, None]
                for other in (src[at[i]], dst[i]):
                    j = np.minimum(np.searchsorted(notes, other), len(notes) - 1)
                    hit = notes[j] == other
                    higher[np.flatnonzero(hit), j[hit]] = False
                above[i] += higher.sum(1)
    yield _batch(src=src[at], dst=dst, above=above)


def link_ranks(chunks: DataFrame, links: DataFrame, eligible: Column | None = None) -> DataFrame:
    """``src, dst, score, rank`` of each link (``src, dst``) by its chunks (``note, v``).

    Only notes that are ``eligible`` (a column of ``chunks``) are targets, or count above one; a
    note never counts for itself. Links to or from notes without chunks, and to oneself, have no
    rank. Cosines are rounded to 6 digits; a note that scores as high doesn't count as above.
    """
    rows = chunks.where("note is not null and v is not null").select("note", "v", (F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))).alias("eligible"))
    n = max(1, -(-rows.count() // BLOCK))
    held = packed(rows, n, _held, "note")
    links = links.where("src <> dst").select("src", "dst").distinct()

    def met(links: DataFrame, names: tuple[str, ...], task, schema: str) -> DataFrame:
        listed = links.groupBy(F.col("src").alias("note")).agg(F.collect_list(F.struct(*names)).alias("targets"))
        asked = packed(rows.select("note", "v").join(listed, "note"), n, _asked(*names), "note")
        return crossed(asked, held, (n, n), task, schema)

    scored = cut(met(links, ("dst",), _score, "src long, dst long, score double"))
    counted = met(scored, ("dst", "score"), _above, "src long, dst long, above long").groupBy("src", "dst").agg(F.sum("above").alias("above"))
    return scored.join(counted, ["src", "dst"]).select("src", "dst", "score", (F.col("above") + 1).alias("rank"))


def link_summary(ranks: DataFrame) -> DataFrame:
    """``sources, pairs, recall_5, recall_10, mrr_first, mrr_per_link`` of ``link_ranks``: recalls and the rank of the first target
    by source, then their mean; and the mean over all links. One row."""
    by = ranks.groupBy("src").agg(F.count("*").alias("n"), *(F.avg((F.col("rank") <= k).cast("double")).alias(f"r{k}") for k in (5, 10)), (1 / F.min("rank")).alias("first"), F.sum(1 / F.col("rank")).alias("each"))
    return by.agg(F.count("*").alias("sources"), F.sum("n").alias("pairs"), F.avg("r5").alias("recall_5"), F.avg("r10").alias("recall_10"), F.avg("first").alias("mrr_first"), (F.sum("each") / F.sum("n")).alias("mrr_per_link"))
