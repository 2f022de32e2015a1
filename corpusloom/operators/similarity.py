"""Exact vector similarity, block by block."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.crossing import crossed, packed
from corpusloom.operators.graph import connected_components
from corpusloom.sources.lineage import cut

#: Vectors in a block of rows, and of queries; queries compared at a time within it.
BLOCK, ASKED, AT_ONCE = 4096, 256, 256
#: Steps of a rounded cosine, and values whose counts travel together.
MILLION, RUN = 1_000_000, 8192


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def quantized(v: Column) -> Column:
    """``scale, data``: signed bytes, scale = greatest size / 127 (1 for zero vectors)."""
    d = F.transform(v, lambda x: x.cast("double"))
    most = F.array_max(F.transform(d, F.abs))
    scale = F.when(most > 0, most / 127).otherwise(1.0)
    return F.struct(scale.alias("scale"), F.transform(d, lambda x: F.floor(x / scale + 0.5).cast("tinyint")).alias("data"))


def dequantized(q: Column) -> Column:
    return F.transform(q["data"], lambda x: x * q["scale"])


def _held(*more: str):
    """What a block of vectors holds: ids in order, the vectors in the smallest type that gives their numbers exactly, more columns."""

    def make(rows: pa.Table) -> tuple:
        rows = rows.sort_by("id")
        v = rows.column("v").combine_chunks()
        size = np.diff(v.offsets.to_numpy())
        if size.min() != size.max():
            raise ValueError(f"vectors of {size.min()} and {size.max()} numbers")
        m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), size[0])
        for kind in (np.uint8, np.float32):
            with np.errstate(invalid="ignore", over="ignore"):
                less = m.astype(kind)
            if (less == m).all():
                m = less
                break
        return rows.column("id").to_numpy(), m, *(rows.column(c).to_pandas().to_numpy() for c in more)

    return make


def _blocks(df: DataFrame, size: int, *more: str, most: int | None = None) -> tuple[DataFrame, int]:
    """The vectors that there are (at most ``most``, if that is known), packed, and into how many blocks."""
    df = df.where("v is not null and id is not null").select("id", "v", *more)
    many = max(1, -(-(df.count() if most is None else most) // size))
    return packed(df, many, _held(*more)), many


def _normed(m: np.ndarray) -> np.ndarray:
    m = m.astype(float)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)


def _task(run, schema: str, kept: bool):
    """A task over one block of queries and several of rows."""
    names = [c.split()[0] for c in schema.split(",")]
    types = [pa.float64() if c.endswith("double") else pa.string() if c.endswith("string") else pa.int64() for c in schema.split(",")]
    batch = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def task(mine, others):
        n, (qid, a, *left) = mine
        a, found = _normed(a), {}
        for m, (ids, b, *right) in others:
            if a.shape[1] != b.shape[1]:
                raise ValueError(f"vectors of {a.shape[1]} and {b.shape[1]} numbers")
            b, out = _normed(b), []
            for s in range(0, len(a), AT_ONCE):
                part = slice(s, s + AT_ONCE)
                cos = np.round(a[part] @ b.T, 6)
                cos[qid[part, None] == ids] = -2
                got = run(qid[part], ids, cos, found.get(s), n == m, *(d for x, y in zip(left, right, strict=True) for d in (x[part], y)))
                if kept:
                    found[s] = got
                else:
                    out.append(got)
            if out:
                yield batch([np.concatenate(c) for c in zip(*out, strict=True)])
        for s, (i, *rest) in found.items():
            yield batch([qid[s + i], *rest])

    return task


def _by_blocks(queries: DataFrame, rows: DataFrame, run, schema: str, *more: str, kept: bool = False, half: bool = False, most: int | None = None) -> DataFrame:
    """Every block of queries meets every block of rows, one after the other in a task, without a copy of either in a shuffle.

    ``run`` gets, some queries at a time, their ids, the ids of the block's rows in order, the cosines
    (rounded to 6 digits; -2 for a vector and itself), what it gave for the same queries before, whether the block meets itself, and the
    columns ``more`` of either side, and gives columns. If they are ``kept``, the first is the place of the query, and only the last go
    out of the task. With ``half``, for queries that are the rows, two blocks meet once."""
    x, nx = _blocks(rows, BLOCK, *more, most=most)
    q, nq = (x, nx) if queries is rows else _blocks(queries, ASKED, *more)
    return crossed(q, x, (nq, nx), _task(run, schema, kept), schema, half)


def best(i: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> tuple:
    """Of each query its k best, nearest first, ties to the smaller id."""
    order = np.lexsort((ids, -cos, i))
    i, ids, cos = i[order], ids[order], cos[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], ids[first], cos[first]


def _grouped(i: np.ndarray, key: np.ndarray, *values: tuple) -> tuple:
    """One row for each ``i, key``; each of ``values`` is a ufunc and what it reduces."""
    order = np.lexsort((key, i))
    i, key = i[order], key[order]
    at = np.flatnonzero(np.r_[len(i) > 0, (i[1:] != i[:-1]) | (key[1:] != key[:-1])]) if len(i) else np.zeros(0, int)
    return i[at], key[at], *(f.reduceat(v[order], at) if len(at) else v for f, v in values)


def joined(had: tuple | None, new: tuple) -> tuple:
    return new if had is None else tuple(np.concatenate(c) for c in zip(had, new, strict=True))


def _nearest(floor: float, k: int):
    def run(names, ids, cos, had, _):
        bar = np.full(len(names), max(floor, -1.0))
        if had is not None:  # queries that have k ask for no less than the last of them
            n = np.bincount(had[0], minlength=len(names))
            bar[n >= k] = had[2][np.cumsum(n)[n >= k] - 1]
        many = np.flatnonzero((cos >= bar[:, None]).sum(1) > k)
        if len(many):  # the k best and all their ties, of which the smallest ids stay
            bar[many] = np.partition(cos[many], -k, axis=1)[:, -k]
        i, j = np.nonzero(cos >= bar[:, None])
        return best(*joined(had, (i, ids[j], cos[i, j])), k)

    return run


def cosines(queries: DataFrame, rows: DataFrame, floor: float, k: int | None = None, below: bool = False, most: int | None = None) -> DataFrame:
    """``query_id, id, cosine`` for pairs of ``queries`` and ``rows`` (``id, v``) at or over a floor.

    A block of each is a product of two matrices; with ``k`` only each query's
    k best of all blocks of a task leave it. ``below`` keeps the pairs with query_id < id, for self-joins;
    a vector never meets its own id. Cosines are rounded to 6 digits. All vectors must have
    one length; null vectors are left out. ``most`` says how many rows there are at most, so that they needn't be counted.
    """
    schema = "query_id long, id long, cosine double"
    if k is not None:
        return _by_blocks(queries, rows, _nearest(floor, k), schema, kept=True, most=most)
    half = below and queries is rows

    def run(names, ids, cos, _, same):
        if below and (same or not half):
            cos[names[:, None] > ids] = -2
        i, j = np.nonzero(cos >= max(floor, -1))
        a, b = names[i], ids[j]
        return (np.minimum(a, b), np.maximum(a, b), cos[i, j]) if half else (a, b, cos[i, j])

    return _by_blocks(queries, rows, run, schema, half=half, most=most)


def linking(rows: DataFrame, floor: float) -> DataFrame:
    """``src, dst``: few pairs of ``rows`` (``id, v``) that join all that the pairs at or over a floor join.

    First each vector's nearest few of its own block make components. Of all pairs then one is
    kept, for some vectors and a block at a time, between any two of these, instead of every one."""
    x, _ = _blocks(rows, BLOCK)
    near = _task(_nearest(floor, 3), "src long, dst long, cosine double", True)

    def own(batches):
        for b in batches:
            for n, block in zip(b.column("n").to_pylist(), b.column("block"), strict=True):
                block = n, pickle.loads(block.as_py())
                yield from near(block, iter([block]))

    parts = cut(connected_components(x.mapInArrow(own, "src long, dst long, cosine double").select("src", "dst")))
    marked = rows.select("id", "v").join(parts.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id", "left").select("id", "v", F.coalesce("grp", "id").alias("grp"))

    def run(names, ids, cos, had, _, mine, theirs):
        i, j = np.nonzero((cos >= max(floor, -1)) & (mine[:, None] != theirs))
        i, j, a, b = *joined(had and had[:2], (i, ids[j])), *joined(had and had[2:], (mine[i], theirs[j]))
        _, _, first = _grouped(a, b, (np.minimum, np.arange(len(a))))
        return i[first], j[first], a[first], b[first]

    between = _by_blocks(marked, marked, run, "src long, dst long, a long, b long", "grp", kept=True, half=True)
    return parts.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(between.select("src", "dst"))


def best_by_group(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """``query_id, grp, cosine``: each query's best cosine in every group (``id, v, grp``); a row for a
    query and group leaves each task, not one for each pair."""

    def run(names, ids, cos, had, _, __, groups):
        order = np.argsort(groups, kind="stable")
        kinds, first = np.unique(groups[order], return_index=True)
        best = np.maximum.reduceat(cos[:, order], first, axis=1)
        i, j = np.nonzero(best >= -1)
        i, kind, best = joined(had, (i, kinds[j].astype(np.int64), best[i, j]))
        return _grouped(i, kind, (np.maximum, best))

    found = _by_blocks(queries, rows, run, "query_id long, grp long, cosine double", "grp", kept=True)
    return found.groupBy("query_id", "grp").agg(F.max("cosine").alias("cosine"))


def sums_by_group(queries: DataFrame, rows: DataFrame, floor: float, *groups: str) -> DataFrame:
    """``query_id, grp, cosine, n``: the sum of the cosines at or over a floor of each query with every
    group of rows (``id, v`` and the columns ``groups`` of whole numbers), and how many they are; a row for a query and group leaves each task."""

    def run(names, ids, cos, had, _, *of):
        i, j = np.nonzero(cos >= max(floor, -1))
        kind = np.concatenate([g[j].astype(np.int64) for g in of[1::2]])
        i, kind, total, n = joined(had, (np.tile(i, len(groups)), kind, np.tile(cos[i, j], len(groups)), np.ones(len(kind), np.int64)))
        return _grouped(i, kind, (np.add, total), (np.add, n))

    queries = queries.select("id", "v", *(F.lit(0).cast("long").alias(g) for g in groups))
    found = _by_blocks(queries, rows, run, "query_id long, grp long, cosine double, n long", *groups, kept=True)
    return found.groupBy("query_id", "grp").agg(F.sum("cosine").alias("cosine"), F.sum("n").alias("n"))


def cosine_counts(rows: DataFrame) -> DataFrame:
    """``cosine, n``: how many pairs of rows (``id, v``) have each cosine, rounded to 6 digits; at
    most two million values, counted in each task and sent as runs of counts."""
    x, n = _blocks(rows, BLOCK)

    def task(mine, others):
        number, (names, a) = mine
        a, total = _normed(a), np.zeros(2 * MILLION + 1, np.int64)
        for m, (ids, b) in others:
            if a.shape[1] != b.shape[1]:
                raise ValueError(f"vectors of {a.shape[1]} and {b.shape[1]} numbers")
            b = _normed(b)
            for s in range(0, len(a), AT_ONCE):
                cos = np.rint(a[s : s + AT_ONCE] @ b.T * MILLION)
                met = names[s : s + AT_ONCE, None]
                cos = cos[(met < ids if number == m else met != ids) & (np.abs(cos) <= MILLION)].astype(np.int64)
                total += np.bincount(cos + MILLION, minlength=len(total))
        runs = [(k, total[k : k + RUN]) for k in range(0, len(total), RUN) if total[k : k + RUN].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in runs], pa.int64()), pa.array([pickle.dumps(t.astype(np.min_scalar_type(t.max())), 5) for _, t in runs], pa.binary())], ["at", "counts"])

    def added(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(pickle.loads(c).astype(np.int64) for c in part["counts"])
        there = np.flatnonzero(total)
        return pd.DataFrame({"cosine": (there + part["at"].iloc[0] - MILLION) / MILLION, "n": total[there]})

    return crossed(x, x, (n, n), task, "at long, counts binary", True).groupBy("at").applyInPandas(added, "cosine double, n long")


def top(pairs: DataFrame, k: int, score: str = "cosine") -> DataFrame:
    """The k best of each query with ``rank`` from 0, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return pairs.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


def hash_embedding(docs: DataFrame, dim: int = 256, key: str = "doc_id") -> DataFrame:
    """``id, bucket, n``: a bag of words hashed into ``dim`` numbers, zeros left out."""
    from corpusloom.functions.text import fnv1a

    words = docs.select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    counted = words.groupBy("id", "w").agg(F.count("*").alias("n"))
    return counted.groupBy("id", F.pmod(fnv1a(F.col("w")), F.lit(dim)).cast("int").alias("bucket")).agg(F.sum("n").alias("n"))


def dense(sparse: DataFrame, dim: int = 256) -> DataFrame:
    """``id, v`` from ``id, bucket, n``."""
    cells = F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double"))))
    return sparse.groupBy("id").agg(cells.alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))


_WORDLESS = np.zeros(256, bool)
_WORDLESS[[*range(48, 58), *range(97, 123)]] = True


def _bags(lengths_at: np.ndarray, data: np.ndarray, dim: int) -> np.ndarray:
    """Rows of bucket counts for the texts between the offsets; FNV-1a a letter of all words at a time."""
    live = _WORDLESS[data]
    first = live.copy()
    first[1:] &= ~live[:-1]
    first[lengths_at[:-1][lengths_at[:-1] < len(data)]] = live[lengths_at[:-1][lengths_at[:-1] < len(data)]]
    start = np.flatnonzero(first)
    doc = np.searchsorted(lengths_at, start, "right") - 1
    ends = np.append(np.flatnonzero(~live), len(data))
    stop = np.minimum(ends[np.searchsorted(ends, start)], lengths_at[doc + 1])
    h, at = np.full(len(start), 2166136261, np.uint64), np.arange(len(start))
    j = 0
    while len(at):
        h[at] = ((h[at] ^ data[start[at] + j]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
        j += 1
        at = at[start[at] + j < stop[at]]
    cells = np.bincount(doc * dim + (h % np.uint64(dim)).astype(np.int64), minlength=(len(lengths_at) - 1) * dim)
    return cells.reshape(-1, dim)


def hash_vectors(docs: DataFrame, dim: int = 256, key: str = "doc_id") -> DataFrame:
    """``id, v``: the vectors of ``hash_embedding``, dense, by numpy over Arrow batches; texts without words have none."""
    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                text = part.column(1).cast(pa.large_string())
                offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                data = np.frombuffer(text.buffers()[2], np.uint8)[offs[0] : offs[-1]] if text.buffers()[2] else np.zeros(0, np.uint8)
                bags = _bags(offs - offs[0], data, dim)
                some = np.flatnonzero(bags.sum(1))
                values = pa.array(bags[some].astype(np.int32).ravel())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), values)], ["id", "v"])

    return docs.select(F.col(key).cast("long").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, "id long, v array<int>")
