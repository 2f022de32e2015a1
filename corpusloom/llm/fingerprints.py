"""Document fingerprints by one-permutation MinHash.

Each distinct five-word shingle of a text is hashed once: the first bits of the hash name
its bin, and the least hash of each bin stays. An empty bin takes the value of another,
the first one that isn't empty in a random order of all bins which is its own and the same
for all texts (optimal densification). Of each value the low-order bits are stored, packed.
Two fingerprints agree in a bin with the probability of their texts' Jaccard similarity, or else
by chance, for which the likeness is corrected.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import by_task, mix, shingles, words

#: Bins of a fingerprint (a power of two), and the bits that are stored of each.
BINS, BITS = 512, 4
#: Words of a shingle.
WIDTH = 5
#: Documents in a range of ids, and ranges at most.
RANGE, RANGES = 1024, 1 << 16
#: Ids sampled for each bound between ranges.
PER_BOUND = 16
#: Texts hashed at a time.
AT_ONCE = 64


@lru_cache(2)
def _order(bins: int) -> np.ndarray:
    """For each bin the place of every bin in its random order."""
    h = mix(np.arange(bins * bins, dtype=np.uint64), 12).reshape(bins, bins)
    return h.argsort(1).argsort(1).astype(np.uint16)


def codes(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """The low-order bits of each bin for a set of hashes, sorted and not empty, a byte each."""
    full, first = np.unique(hashes >> np.uint64(64 - (bins.bit_length() - 1)), return_index=True)
    full = full.astype(np.int64)
    out = np.zeros(bins, np.uint64)
    out[full] = hashes[first]
    if len(full) < bins:
        void = np.setdiff1d(np.arange(bins), full, assume_unique=True)
        taken = hashes[first][_order(bins)[np.ix_(void, full)].argmin(1)]
        # mixed with the bin, so that bins which take one value don't all meet another by chance together
        out[void] = mix(taken + void.astype(np.uint64), 21)
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint8)


def sketch(texts: pa.Array) -> list[bytes]:
    """The packed fingerprint of each text; no bytes for a text without words."""
    out = []
    for a in range(0, len(texts), AT_ONCE):
        w, at = words(texts.slice(a, AT_ONCE))[:2]
        for b, c in zip(at[:-1], at[1:], strict=True):
            s = shingles(w[b:c], WIDTH)
            if len(s):
                x = codes(s)
                out.append((x[::2] << BITS | x[1::2]).tobytes())
            else:
                out.append(b"")
    return out


def likeness(a: bytes, b: bytes) -> float:
    """The estimated Jaccard similarity of two texts' shingles: the share of bins that agree,
    less those that do by chance. Two texts without words are alike, one of them with another isn't."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    share = (np.count_nonzero(x >> BITS == 0) + np.count_nonzero(x & ((1 << BITS) - 1) == 0)) / BINS
    chance = 2.0**-BITS
    return float(max(0.0, (share - chance) / (1 - chance)))


def _text(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


def fingerprints(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` columns and ``fingerprint`` (base64) of each row's text, without a shuffle.

    Equal texts have equal fingerprints. Words are runs outside white space, A-Z as a-z; a
    text of fewer than five is one shingle, one without words (or null) has an empty
    fingerprint. Texts may be of any length; repeated rows come out alike; an empty table
    gives an empty result.
    """
    by_task(docs.sparkSession)
    kept = docs.select(F.col("text").cast("string"), *keep)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([_text(x) for x in sketch(batch.column(0))], pa.string())], [*batch.schema.names[1:], "fingerprint"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, f"{schema}fingerprint string")


def with_likeness(pairs: DataFrame, a: str, b: str, name: str = "likeness") -> DataFrame:
    """Adds the likeness of two columns of fingerprints; null where either is null."""

    def run(batches):
        for batch in batches:
            both = zip(batch[a].to_pylist(), batch[b].to_pylist(), strict=True)
            got = [None if x is None or y is None else likeness(base64.b64decode(x), base64.b64decode(y)) for x, y in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{schema}, `{name}` double")


def _followed(docs: DataFrame) -> DataFrame:
    """``part, last, doc_id, text``: rows by descending doc_id in ranges ``part``, each range in one
    task and in order, and after it (``last`` 1) the row that comes next: the first of the
    next range, or of all.

    Bounds between ranges come from a sample of ids. Texts are read once to find the first row
    of each range, and again to be shuffled.
    """
    spark = docs.sparkSession
    # ~id falls as the id grows, whatever its size
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    down, tie = F.bitwise_not("doc_id"), F.xxhash64("text")
    n = docs.where("doc_id is not null").count()
    ranges = 1
    while ranges < min(RANGES, n / RANGE):
        ranges *= 2
    share = min(1.0, PER_BOUND * ranges / max(1, n))
    drawn = docs.where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)) if ranges > 1 else docs.limit(0)
    # at most PER_BOUND * RANGES ids in expectation
    ids = np.sort(drawn.select(down.alias("d")).distinct().toPandas()["d"].to_numpy(np.int64))
    bounds = ids[np.arange(1, ranges) * len(ids) // ranges] if len(ids) else np.zeros(0, np.int64)
    part = F.lit(0)
    if len(bounds):
        held, steps, k = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), [], ranges // 2
        while k:
            steps.append(k)
            k //= 2
        # how many bounds are at most the id, by halves
        part = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(F.element_at(held, lo + s) <= down, lo + s).otherwise(lo))
    # rows without an id come last, in ranges of their text's hash
    part = F.when(F.col("doc_id").isNull(), F.lit(ranges) + 512 + F.shiftright(tie, 54).cast("int")).otherwise(part)
    rows = docs.select(part.alias("part"), down.alias("down"), "doc_id", "text")
    some = rows.where("doc_id is not null").groupBy("part").agg(F.min("down").alias("first")).collect()  # RANGES rows at most
    none = rows.where("doc_id is null").groupBy("part").agg(F.min(tie).alias("first")).collect()  # 1,024 at most
    parts = sorted((r["part"], r["first"]) for r in some + none)
    after = [(parts[k - 1][0], p >= ranges, first) for k, (p, first) in enumerate(parts)]
    after = F.broadcast(spark.createDataFrame(after, "target int, unnamed boolean, first long"))
    firsts = rows.join(after, F.col("doc_id").isNull().eqNullSafe(F.col("unnamed")) & (F.coalesce("down", tie) == F.col("first")))
    firsts = firsts.groupBy("target").agg(F.min(F.struct(tie.alias("tie"), "doc_id", "text")).alias("f"))
    firsts = firsts.select(F.col("target").alias("part"), F.bitwise_not("f.doc_id").alias("down"), "f.doc_id", "f.text", F.lit(1).alias("last"))
    every = rows.withColumn("last", F.lit(0)).unionByName(firsts).withColumn("tie", tie)
    return every.repartition("part").sortWithinPartitions("part", "last", F.asc_nulls_last("down"), "tie").select("part", "last", "doc_id", "text")


def edit_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: each text,
    and what becomes of it when its last third (in code points, rounded down) gives way to
    as many of the first ones of the next document, by descending doc_id, after the last the first.

    Likenesses are from 0 to 1. Null texts are empty; an empty text's fingerprint is empty. Rows
    of one id follow each other by a hash of their texts, those without an id come last by
    the same hash, so reruns agree but for the order of equal rows. A single row follows
    itself; an empty table gives an empty result. Neighbours meet in ranges of ids of
    about ``RANGE`` rows; texts cross the network once and go through a task in batches.
    """
    by_task(docs.sparkSession)

    def reported(rows: list) -> pa.RecordBatch:
        """Of rows ``doc_id, text, fingerprint, next text, next fingerprint``."""
        edited = []
        for _, text, _, after, _ in rows:
            k = len(text) // 3
            edited.append(text[: len(text) - k] + after[:k])
        prints = sketch(pa.array(edited, pa.large_string()))
        columns = [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([_text(r[2]) for r in rows]), pa.array([_text(x) for x in prints]), pa.array([likeness(r[2], x) for r, x in zip(rows, prints, strict=True)], pa.float64()), pa.array([likeness(r[2], r[4]) for r in rows], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        held = None
        for whole in batches:
            for a in range(0, len(whole), AT_ONCE):
                batch, rows = whole.slice(a, AT_ONCE), []
                for part, last, doc_id, text, mark in zip(*(batch.column(k).to_pylist() for k in range(4)), sketch(batch.column(3)), strict=True):
                    if held:
                        if held[0] != part:
                            raise ValueError(f"nothing follows the last row of range {held[0]}")
                        rows.append((*held[1:], text, mark))
                    held = None if last else (part, doc_id, text, mark)
                if rows:
                    yield reported(rows)
        if held:
            raise ValueError(f"nothing follows the last row of range {held[0]}")

    return _followed(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
