"""Hard negatives by rotated one-bit codes.

A vector of length one is rotated and each coordinate's sign kept: a code, and with it how
far vector and code are aligned. The same is done with what the code leaves over, level
after level, each in a rotation of its own. An anchor is rotated alike and cut into bit
planes, so that its product with a code is a few counts of common bits. Alignment times
that is the estimate of the inner product, and by Cauchy and Schwarz what it misses
is at most the length of what is left over times the part of the anchor beside the code,
so each pair has an interval that surely holds its score. Pairs whose interval can't be
among the answers go; all others get their exact integer score.

All anchors meet all rows, in blocks of bounded size, first for the best rows of their
own label, then for the best of others within reach of each of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.blocks import by_task
from corpusloom.sources.lineage import cut

#: Levels of codes, and bits of an anchor's coordinate.
LEVELS, PLANES = 6, 8
#: Rows and anchors in one task's block, and anchors that are compared at a time.
BLOCK, ANCHORS, AT_ONCE = 4096, 16384, 128
#: Pairs whose exact scores are computed at a time.
PAIRS = 1 << 15
#: Once so few of the pairs are left, exact scores cost less than finer intervals.
FEW = 0.01
#: Whole numbers below are exact as doubles.
EXACT = float(1 << 53)


@lru_cache(16)
def _signs(dim: int, level: int) -> np.ndarray:
    return np.where(np.random.default_rng([dim, level, 11]).random((3, dim)) < 0.5, -1.0, 1.0)


def rotated(x: np.ndarray, level: int) -> np.ndarray:
    """The rows in a fixed random rotation: three rounds of random signs and a Hadamard transform."""
    n = x.shape[1]
    for signs in _signs(n, level):
        x, h = x * signs, 1
        while h < n:
            y = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
            h *= 2
        x = x / np.sqrt(n)
    return x


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length one, filled with zeros to a power of two and 64 at least, and their lengths."""
    size = np.sqrt((x.astype(float) ** 2).sum(1))
    dim = max(64, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), dim))
    out[:, : x.shape[1]] = x / np.where(size > 0, size, 1)[:, None]
    return out, size


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


class Codes(NamedTuple):
    """Rows as codes: words of bits by level, and length, alignments and lengths of what is left over."""

    bits: np.ndarray  # rows, levels, words
    size: np.ndarray
    aligned: np.ndarray  # rows, levels
    left: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        y, size = _units(x)
        bits, aligned, left = [], [], []
        for level in range(LEVELS):
            y = rotated(y, level)
            code = np.where(y > 0, 1.0, -1.0) / np.sqrt(y.shape[1])
            a = (y * code).sum(1)
            y = y - a[:, None] * code
            bits.append(_packed(code > 0))
            aligned.append(a)
            left.append(np.sqrt((y * y).sum(1)))
        return cls(np.stack(bits, 1), size, np.stack(aligned, 1), np.stack(left, 1))


class Asked(NamedTuple):
    """Anchors as bit planes: coordinate = low + step * number, but for rest (their sum)."""

    planes: np.ndarray  # levels, anchors, planes, words
    low: np.ndarray  # levels, anchors
    step: np.ndarray
    total: np.ndarray
    rest: np.ndarray
    size: np.ndarray
    dim: int

    @classmethod
    def of(cls, x: np.ndarray) -> Asked:
        y, size = _units(x)
        got: list[list[np.ndarray]] = [[] for _ in range(5)]
        for level in range(LEVELS):
            y = rotated(y, level)
            low = y.min(1)
            step = np.maximum((y.max(1) - low) / ((1 << PLANES) - 1), 1e-12)
            k = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
            rest = np.abs(y - low[:, None] - step[:, None] * k).sum(1)
            for to, value in zip(got, (np.stack([_packed((k >> j) & 1) for j in range(PLANES)], 1), low, step, k.sum(1), rest), strict=True):
                to.append(value)
        return cls(*map(np.stack, got), size, y.shape[1])


def intervals(q: Asked, x: Codes, part: slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest score of each pair of the anchors in ``part`` and all rows, closer from level to level."""
    root, scale = np.sqrt(q.dim), q.size[part, None] * x.size
    slack = 1e-9 * scale + 1e-6  # more than rounding takes
    estimate, missed = np.zeros_like(scale), np.zeros_like(scale)
    low, high = np.full_like(scale, -np.inf), np.full_like(scale, np.inf)
    for level in range(LEVELS):
        bits = x.bits[:, level]
        ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
        common = np.zeros(scale.shape, np.int64)
        for j in range(PLANES):
            plane = q.planes[level, part, j]
            for w in range(bits.shape[1]):
                common += np.bitwise_count(plane[:, w, None] & bits[:, w]).astype(np.int64) << j
        # sums of coordinates by the code's signs
        dot = (q.low[level, part, None] * (2 * ones - q.dim) + q.step[level, part, None] * (2 * common - q.total[level, part, None])) / root
        rest = q.rest[level, part, None] / root
        estimate += x.aligned[:, level] * dot
        missed += x.aligned[:, level] * rest
        beside = np.sqrt(np.maximum(0.0, 1 - np.maximum(0.0, np.abs(dot) - rest) ** 2))
        error = missed + x.left[:, level] * beside
        low, high = np.maximum(low, (estimate - error) * scale - slack), np.minimum(high, (estimate + error) * scale + slack)
        yield low, high


def products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The integer inner products of pairs of rows, so many at a time."""
    return np.concatenate([np.einsum("pd,pd->p", q[i[a : a + PAIRS]], x[j[a : a + PAIRS]]) for a in range(0, max(1, len(i)), PAIRS)])


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, as a column; -inf where there are fewer."""
    return np.partition(values, -k, 1)[:, -k, None] if values.shape[1] >= k else np.full((len(values), 1), -np.inf)


def _first(k: int, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Of pairs the places of each i's k greatest scores, ties to the smaller j, in that order."""
    order = np.lexsort((j, -score, i))
    return order[np.arange(len(i)) - np.searchsorted(i[order], i[order]) < k]


def _surviving(q: Asked, x: Codes, part: slice, may: np.ndarray, judge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The pairs of ``may`` that ``judge`` leaves, by closer and closer intervals."""
    for low, high in intervals(q, x, part):
        may = may & judge(low, high)
        if may.mean() <= FEW:
            break
    return np.nonzero(may)


def best_of_label(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, names: np.ndarray, kinds: np.ndarray, x: np.ndarray, codes: Codes, k: int) -> tuple[list, int]:
    """For each anchor, ``(anchor, row, score)`` of its k best other rows of its label in a block
    (rows by ascending id in ``names``), and how many pairs were scored."""
    asked, out, scored = Asked.of(q), [], 0
    for a in range(0, len(q), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        may = (labels[part, None] == kinds) & (ids[part, None] != names)
        i, j = _surviving(asked, codes, part, may, lambda low, high, may=may: high >= _kth(np.where(may, low, -np.inf), k))
        score = products(q[part], x, i, j)
        first = _first(k, i, j, score)
        out.append((ids[part][i[first]], names[j[first]], score[first]))
        scored += len(i)
    return out, scored


def best_below(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, caps: list[np.ndarray], names: np.ndarray, kinds: np.ndarray, x: np.ndarray, codes: Codes, k: int, percent: int) -> tuple[list, int]:
    """For each anchor and each of its ``caps``, ``(anchor, cap, row, score)`` of the k best rows of another
    label with percent * cap <= 100 * score <= 100 * cap, and how many pairs were scored."""
    asked, out, scored = Asked.of(q), [], 0
    most = max((len(c) for c in caps), default=0)
    table = np.full((len(q), most), -1, np.int64)  # caps below 0 have no room under them
    for at, c in enumerate(caps):
        table[at, : len(c)] = c
    for a in range(0, len(q), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        cap = table[part]

        def judge(low, high, cap=cap, may=labels[part, None] != kinds):
            alive = np.zeros(low.shape, bool)
            for c in cap.T[:, :, None]:
                least = c * (percent / 100) - 1e-9 * np.abs(c)
                inside = may & (low >= c * (percent / 100) + 1e-9 * np.abs(c)) & (high <= c)
                alive |= (c >= 0) & (low <= c) & (high >= np.maximum(least, _kth(np.where(inside, low, -np.inf), k)))
            return alive

        i, j = _surviving(asked, codes, part, labels[part, None] != kinds, judge)
        score = products(q[part], x, i, j)
        scored += len(i)
        for c in cap.T:
            least = c // 100 * percent - (c % 100 * -percent) // 100  # percent * c / 100 rounded up, without a product that might not fit
            fit = np.flatnonzero((c[i] >= 0) & (score <= c[i]) & (score >= least[i]))
            first = fit[_first(k, i[fit], j[fit], score[fit])]
            out.append((ids[part][i[first]], c[i[first]], names[j[first]], score[first]))
    return out, scored


def coded(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, dim, v array<long>, code, shape``: the rows that take part, as whole numbers
    floor(scale * x), with their codes; of an id's different rows the least counts."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).where("vec_id is not null and label is not null and v is not null")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", F.size("s.v").alias("dim"), F.transform("s.v", lambda x: F.floor(x * scale)).alias("v"))

    def run(batches):
        for batch in batches:
            dims, out = batch.column(2).to_numpy(), []
            code, shape = [None] * len(dims), [None] * len(dims)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.asarray(batch.column(3).take(pa.array(at)).flatten(), np.int64).reshape(len(at), dim)
                c = Codes.of(x)
                out = np.concatenate([c.size[:, None], c.aligned, c.left], 1)
                for k, row in enumerate(at):
                    code[row], shape[row] = c.bits[k].ravel().view(np.int64), out[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.list_(pa.int64())), pa.array(shape, pa.list_(pa.float64()))], [*batch.schema.names, "code", "shape"])

    return rows.mapInArrow(run, "vec_id long, label long, dim int, v array<long>, code array<long>, shape array<double>")


def _matrix(values: pd.Series, kind) -> np.ndarray:
    return np.stack([np.asarray(x, kind) for x in values])


def _side(held: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, Codes]:
    """Ids, labels, vectors and codes of a block's rows, by ascending id."""
    held = held.sort_values("vec_id")
    shape, bits = _matrix(held["shape"], float), _matrix(held["code"], np.int64).view(np.uint64)
    codes = Codes(bits.reshape(len(held), LEVELS, -1), shape[:, 0], shape[:, 1 : 1 + LEVELS], shape[:, 1 + LEVELS :])
    return held["vec_id"].to_numpy(np.int64), held["label"].to_numpy(np.int64), _matrix(held["v"], np.int64), codes


def _frame(out: list, names: tuple[str, ...]) -> pd.DataFrame:
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(names)
    return pd.DataFrame(dict(zip(names, cols, strict=True)))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors`` (vec_id, embedding, label).

    Scores are inner products of floor(scale * x) with the anchor, greater first, ties to the
    smaller id. Anchors are rows whose id is divisible by ``every``, their positives their
    best other rows of the same label, and the negatives of a positive the best rows of
    another label that have ``percent`` of its score at least and no more than it.

    Rows with a null id, label or vector, or a null or non-finite number in it, take no
    part. Vectors of different lengths never meet; an empty one scores 0. Of several rows
    of one id that with the least label and then vector counts, copies count once.
    A positive without any such negative has no row; an empty table has no result.
    """
    by_task(vectors.sparkSession, 4096)
    rows = cut(coded(vectors, scale))
    asked = F.pmod("vec_id", F.lit(every)) == 0
    n, m = rows.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    xs, qs = max(1, -(-n // BLOCK)), max(1, -(-m // ANCHORS))
    spread = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    key = ["dim", "xb", "qb"]
    x = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(xs)).cast("int").alias("xb"), spread(qs).alias("qb"), "vec_id", "label", "v", "code", "shape")
    anchors = rows.where(asked).select(F.col("dim").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(qs)).cast("int").alias("qb"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("own"), F.col("v").alias("qv"))

    def near(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(held):
            names, kinds, v, codes = _side(held)
            out, _ = best_of_label(queries["anchor_id"].to_numpy(np.int64), queries["own"].to_numpy(np.int64), _matrix(queries["qv"], np.int64), names, kinds, v, codes, positives)
        return _frame(out, ("anchor_id", "positive_id", "positive_score"))

    def below(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(held):
            names, kinds, v, codes = _side(held)
            out, _ = best_below(queries["anchor_id"].to_numpy(np.int64), queries["own"].to_numpy(np.int64), _matrix(queries["qv"], np.int64), [np.asarray(c, np.int64) for c in queries["caps"]], names, kinds, v, codes, negatives, percent)
        return _frame(out, ("anchor_id", "positive_score", "negative_id", "negative_score"))

    def best(found: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)

    met = anchors.withColumn("xb", spread(xs)).groupBy(*key).cogroup(x.groupBy(*key)).applyInPandas(near, "anchor_id long, positive_id long, positive_score long")
    chosen = cut(best(met, ["anchor_id"], [F.desc("positive_score"), "positive_id"], positives).drop("rank"))
    caps = chosen.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("caps"))
    room = anchors.join(caps, "anchor_id").withColumn("xb", spread(xs))
    found = room.groupBy(*key).cogroup(x.groupBy(*key)).applyInPandas(below, "anchor_id long, positive_score long, negative_id long, negative_score long")
    found = best(found, ["anchor_id", "positive_score"], [F.desc("negative_score"), "negative_id"], negatives)
    return chosen.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB SQL with the rows of ``hard_negatives(embeddings)``.
NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 256)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, CAST(list_dot_product(a.v, x.v) AS BIGINT) AS score
  FROM r a JOIN r x ON x.vec_id <> a.vec_id AND len(x.v) = len(a.v) WHERE a.vec_id % 100 = 0
), y AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), z AS (
  SELECT y.*, p.id AS negative_id, p.score AS negative_score, CAST(row_number() OVER (PARTITION BY y.anchor_id, y.positive_id ORDER BY p.score DESC, p.id) AS INTEGER) AS rank
  FROM y JOIN p ON p.anchor_id = y.anchor_id AND NOT p.same AND 80 * y.positive_score <= 100 * p.score AND p.score <= y.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM z WHERE rank <= 5
"""
