"""Approximate nearest neighbours: inverted file with product-quantised residuals.

Coarse centroids and code books are fitted on a bounded sample; every vector is
indexed, as its cell, one byte per subspace of what is left after its centroid, and
how far its code is off. A query looks at the cells of its nearest centroids and estimates
distances to their codes by a table of its own inner products with the code words (the
query itself isn't quantised). Each estimate has an error that its code's own bounds; every
vector that may be among the nearest within it is ranked by the exact measure on the original
vectors, few where codes tell vectors apart and whole clusters where they don't.

There are about as many cells as the root of the number of vectors. How many a query
looks at is measured for queries against the sample: so many that ``REACHED`` of their nearest
ones there are met, few where vectors cluster and many where they don't.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import by_task
from corpusloom.llm.vectors import matrix, ranked, usable
from corpusloom.sources.lineage import cut

#: Vectors that the centroids and code books are fitted on, in expectation: so many, or so many for each cell.
SAMPLE, PER_CELL = 16_000, 64
#: Cells at most, subspaces and words of a code book.
CELLS, SUBSPACES, WORDS = 1024, 16, 256
#: The share of near ones of the sample that a query's cells must reach, and the queries it is measured on.
REACHED, MEASURED = 0.97, 400
#: Index rows and queries in one task's block, and the numbers of either's vectors.
BLOCK, QUERIES, NUMBERS = 16_384, 4096, 1 << 20
#: Errors of estimates are taken for so many times the largest one measured; distances are exact up to the second number, cosines of any order of summing up to the third.
WIDER, EXACT, ROUNDED = 1.25, 1e-7, 1e-11


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's algorithm; fewer than k distinct points give fewer."""
    points = np.unique(x, axis=0)
    c = points[np.random.default_rng(seed).permutation(len(points))[:k]]
    for _ in range(rounds):
        own = _closest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, so many rows at a time that their distances fit."""
    step, half = max(1, (1 << 22) // len(c)), (c * c).sum(1) / 2
    return np.concatenate([np.zeros(0, np.int64)] + [(half - x[a : a + step] @ c.T).argmin(1) for a in range(0, len(x), step)])


class Quantizer:
    """Centroids and code books for unit vectors of one dimension.

    What is measured is measured for ``asked``, of which ``own`` has the rows in the sample (-1: none),
    or else for vectors of the sample."""

    def __init__(self, sample: np.ndarray, cells: int, asked: np.ndarray | None = None, own: np.ndarray | None = None):
        self.centroids = kmeans(sample, cells)
        cell = self.cells(sample)
        rest = sample - self.centroids[cell]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [kmeans(rest[:, d], WORDS, 6) for d in self.cuts]
        if asked is None:
            own = np.random.default_rng(11).permutation(len(sample))[:MEASURED]
            asked = sample[own]
        self.probed, self.slack = self._measured(sample, cell, asked, own)

    def _order(self, x: np.ndarray) -> np.ndarray:
        """Cells of each vector, the nearest centroid first."""
        c = self.centroids
        return np.argsort((c * c).sum(1) - 2 * x @ c.T, axis=1, kind="stable")

    def _measured(self, sample: np.ndarray, cell: np.ndarray, asked: np.ndarray, own: np.ndarray, k: int = 5) -> tuple[int, float]:
        """How many cells a vector must look at to reach its nearest ones of the sample, and the largest cosine
        between the way to one of them and the error of its code (1: nothing is known)."""
        k = min(k, len(sample) - 1)
        if k < 1 or not len(asked):
            return len(self.centroids), 1.0
        cos = asked @ sample.T
        there = np.flatnonzero(own >= 0)
        cos[there, own[there]] = -2
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        place = np.argsort(self._order(asked), axis=1)  # of each cell
        reach = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
        x = sample[near.ravel()]
        off = self.decoded(cell[near.ravel()], self.codes(x, cell[near.ravel()])) - x
        way = np.repeat(asked, k, axis=0) - x
        size = np.sqrt((way * way).sum(1)), np.sqrt((off * off).sum(1))
        told = np.minimum(*size) > EXACT
        cosines = np.abs((way * off).sum(1))[told] / (size[0] * size[1])[told]
        return int(reach[min(len(reach) - 1, int(REACHED * len(reach)))]) + 1, min(1.0, WIDER * cosines.max()) if len(cosines) else 1.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _closest(x, self.centroids)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[cell]
        return np.stack([_closest(rest[:, d], b) for d, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)

    def decoded(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What vectors of these codes are taken for."""
        return self.centroids[cell] + np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], 1)

    def probes(self, q: np.ndarray) -> np.ndarray:
        return self._order(q)[:, : self.probed]

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Of each query and subspace the inner products with all code words."""
        return [q[:, d] @ b.T for d, b in zip(self.cuts, self.books, strict=True)]

    def scores(self, q: np.ndarray, tables: list[np.ndarray], cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries, given their tables, with coded vectors of one cell."""
        out = np.repeat((q @ self.centroids[cell])[:, None], len(codes), 1)
        for k, t in enumerate(tables):
            out += np.take(t, codes[:, k], axis=1)
        return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest numbers near 1, so that squares neither overflow nor vanish; cosines stay, to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _in_order(terms: np.ndarray) -> np.ndarray:
    """Sums of columns, added from the first row to the last, so that equal columns have equal sums wherever they stand."""
    return np.add.accumulate(terms, axis=0)[-1]


def _bins(sizes: dict[int, int], block: int | None = None) -> dict[int, tuple[int, int]]:
    """For each cell its bin and the blocks of it: small cells share a bin of up to ``BLOCK`` rows, a large one has several blocks."""
    out, bin_, room, block = {}, -1, 0, block or BLOCK
    for cell, n in sorted(sizes.items()):
        if n > room:
            bin_, room = bin_ + 1, block
        out[cell] = bin_, max(1, -(-n // block))
        room -= n
    return out


class _Held:
    """The index rows of a block, by cell; of equal vectors only the ``k`` + 1 of the least ids, as no query has more among its nearest."""

    def __init__(self, rows: pd.DataFrame, model: Quantizer, k: int):
        rows = rows.sort_values("vec_id")
        rows = rows[rows.groupby("v").cumcount() <= k].sort_values(["cell", "vec_id"])
        self.model, self.k, self.ids, cell = model, k, rows["vec_id"].to_numpy(), rows["cell"].to_numpy()
        self.codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        self.own, self.wide = rows["own"].to_numpy(), rows["off"].to_numpy() * model.slack
        self.x = _scaled(np.frombuffer(b"".join(rows["v"])).reshape(len(rows), -1))
        self.norms = np.sqrt(_in_order(np.ascontiguousarray(self.x.T) ** 2))
        self.cells, first = np.unique(cell, return_index=True)
        self.parts = list(zip(first, np.append(first[1:], len(cell)), strict=True))

    def estimates(self, qs: np.ndarray, probes: list) -> np.ndarray:
        """Minus half of the squared distances of unit queries and rows of the cells they look at, as codes tell them; others are infinite."""
        tables, out = self.model.tables(qs), np.full((len(qs), len(self.ids)), -np.inf)
        mine = np.zeros((len(qs), len(self.cells)), bool)
        for i, p in enumerate(probes):
            mine[i, np.searchsorted(self.cells, np.intersect1d(self.cells, p))] = True
        for j in np.flatnonzero(mine.any(0)):
            i, (a, b) = np.flatnonzero(mine[:, j]), self.parts[j]
            out[i, a:b] = self.model.scores(qs[i], [t[i] for t in tables], int(self.cells[j]), self.codes[a:b]) - self.own[a:b]
        return out

    def cosines(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The exact measure, but for rounding."""
        return self.x[at] @ q / (np.sqrt(q @ q) * self.norms[at])

    def best(self, name: int, q: np.ndarray, estimates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest of the rows that a query looks at."""
        at = np.flatnonzero((estimates > -np.inf) & (self.ids != name))
        if len(at) > self.k:
            # an estimate is off by the slack times the distance times the code's error, so the distance is at least
            least = np.sqrt(np.maximum(0, self.wide[at] ** 2 - 2 * estimates[at])) - self.wide[at]
            some = at[np.argpartition(-estimates[at], self.k - 1)[: self.k]]
            at = at[least <= np.sqrt(max(0.0, 2 - 2 * self.cosines(q, some).min())) + EXACT]
        if len(at) > self.k:
            roughly = self.cosines(q, at)
            at = at[roughly >= np.partition(roughly, -self.k)[-self.k] - ROUNDED]
        x = np.ascontiguousarray(self.x[at].T)
        scores = _in_order(x * q[:, None]) / (np.sqrt(_in_order(q[:, None] ** 2)) * self.norms[at])
        first = np.lexsort((self.ids[at], -scores))[: self.k]
        return self.ids[at[first]], scores[first]


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest by cosine that the index finds for
    each row whose id is divisible by ``every``, its own row left out, ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite numbers take no part, nor do
    rows without an id; those of another length than most are left out too. Repeated
    rows of an id count once. Few or no rows give as many results as there are.
    """
    spark = vectors.sparkSession
    by_task(spark, 4096)
    rows = cut(usable(vectors, nonzero=True))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dim)
    cells = min(CELLS, max(16, 1 << round(np.log2(n) / 2)))
    share = min(1.0, max(SAMPLE, PER_CELL * cells) / n)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("centroids")), F.lit(1 << 30)) < share * (1 << 30))
    sample = drawn.orderBy("vec_id").select("vec_id", "v").toArrow()  # bounded, in expectation
    if not len(sample):
        sample = rows.orderBy("vec_id").limit(1).select("vec_id", "v").toArrow()
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "v")
    some = asked.orderBy(F.xxhash64("query_id", F.lit("measured")), "query_id").limit(MEASURED).toArrow()
    ids, names = sample.column(0).to_numpy(), some.column(0).to_numpy()
    own = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
    model = Quantizer(_unit(matrix(sample.column(1))), cells, _unit(matrix(some.column(1))) if len(some) else np.zeros((0, dim)), np.where(ids[own] == names, own, -1))
    shared = spark.sparkContext.broadcast(model)

    def index(batches):
        for batch in batches:
            if len(batch):
                v = matrix(batch.column(1))
                x = _unit(v)
                cell = shared.value.cells(x)
                codes = shared.value.codes(x, cell)
                taken = shared.value.decoded(cell, codes)
                numbers = [pa.array((x * taken).sum(1)), pa.array(np.sqrt(((x - taken) ** 2).sum(1)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), *numbers, pa.array([r.tobytes() for r in v], pa.binary())],
                    ["vec_id", "cell", "codes", "own", "off", "v"],
                )

    # own: the inner product of the vector and what its code stands for; off: how far they lie apart
    coded = cut(rows.mapInArrow(index, "vec_id long, cell int, codes binary, own double, off double, v binary"))
    block, queries = (max(1, min(most, NUMBERS // dim)) for most in (BLOCK, QUERIES))
    bins = _bins({r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}, block)  # a row for each cell

    def probe(batches):
        for batch in batches:
            if len(batch):
                found = []
                for row in shared.value.probes(_unit(matrix(batch.column(1)))).tolist():
                    by_bin: dict[int, list[int]] = {}
                    for cell in row:
                        if cell in bins:
                            by_bin.setdefault(bins[cell][0], []).append(cell)
                    found.append([{"bin": b, "cells": c} for b, c in by_bin.items()])
                kind = pa.list_(pa.struct([("bin", pa.int32()), ("cells", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], ["query_id", "v", "probed"])

    probed = asked.mapInArrow(probe, "query_id long, v array<double>, probed array<struct<bin:int,cells:array<int>>>")
    probed = cut(probed.select("query_id", "v", F.explode("probed").alias("p")).select("query_id", "v", "p.*"))
    # bins of any size: their rows and queries are dealt over blocks of bounded size; a query goes to a block once
    places = spark.createDataFrame([(c, b, x) for c, (b, x) in bins.items()], "cell int, bin int, xs int")
    blocks = places.groupBy("bin").agg(F.max("xs").alias("xs")).join(probed.groupBy("bin").agg(F.ceil(F.count("*") / queries).cast("int").alias("qs")), "bin")
    blocks = F.broadcast(cut(blocks))  # a row for each bin
    spread = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    x = coded.join(F.broadcast(places.drop("xs")), "cell").join(blocks, "bin").select("bin", F.pmod(F.xxhash64("vec_id"), F.col("xs")).cast("int").alias("xb"), spread("qs").alias("qb"), "vec_id", "cell", "codes", "own", "off", "v")
    q = probed.join(blocks, "bin").select("bin", spread("xs").alias("xb"), F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int").alias("qb"), "query_id", "v", "cells")

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            rows, names, probes = _Held(held, shared.value, k), asked["query_id"].to_numpy(), asked["cells"].to_list()
            v = np.stack(asked["v"].to_list()).astype(float)
            unit, v = _unit(v), _scaled(v)
            for a in range(0, len(v), 64):
                for i, row in enumerate(rows.estimates(unit[a : a + 64], probes[a : a + 64]), a):
                    ids, scores = rows.best(names[i], v[i], row)
                    out.append((np.full(len(ids), names[i]), ids, scores))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    key = ["bin", "xb", "qb"]
    found = q.groupBy(*key).cogroup(x.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double")
    return ranked(found, k)
