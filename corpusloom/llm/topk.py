"""Exact top-k by inner product over integer vectors, by segment statistics.

With equal lengths, the greatest inner product q.x is the least |q - x|**2 - |x|**2, and
for a segment of L numbers the means m and deviations s bound the distance from below:
L * ((m_q - m_x)**2 + (s_q - s_x)**2) <= |q - x|**2 there. In terms of the inner product
that is q.x <= sum of L * (m_q * m_x + s_q * s_x). The bounds are taken with few long
segments, then more short ones; pairs that can still be among the k best get exact
products. All rows are dealt into blocks of bounded size, and so are the queries; within
a block the longest vectors come first, and the k-th best score so far goes on from part
to part, so that parts in which no row can reach it are left out whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import by_task
from corpusloom.llm.vectors import ranked, usable
from corpusloom.sources.lineage import cut

#: Rows and queries in one task's block.
BLOCK, QUERIES = 8192, 2048
#: Segments, coarse to fine.
LEVELS = (4, 16)
#: Queries compared at a time within a block, and rows.
AT_ONCE, PART = 128, 1024
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)
#: Under every score.
LEAST = -(1 << 63)


def summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner product bounds that of the rows of ``x`` from above."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    root = np.sqrt([len(p) for p in parts])
    return np.concatenate([np.stack([x[:, p].mean(1) for p in parts], 1) * root, np.stack([x[:, p].std(1) for p in parts], 1) * root], 1)


def search(q: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query the places and products of its k best rows, ties to the earlier
    place, and for how many pairs in all the bounds left an exact product to compute.

    ``q`` and ``x`` hold whole numbers (int64); ``own`` is the place of the query's own
    row, which is never a result, or -1."""
    out, computed = [], 0
    qf, xf = q.astype(float), x.astype(float)
    size = np.sqrt((xf * xf).sum(1))
    order = np.argsort(-size, kind="stable")
    x, xf, place = x[order], xf[order], order
    where = np.full(len(x) + 1, -1)
    where[order] = np.arange(len(x))
    levels = [summary(xf, n) for n in LEVELS]
    for a in range(0, len(q), AT_ONCE):
        part, whole, mine = qf[a : a + AT_ONCE], q[a : a + AT_ONCE], where[own[a : a + AT_ONCE]]
        length = np.sqrt((part * part).sum(1))[:, None]
        coarse = [summary(part, n) for n in LEVELS]
        # sums of products stay below the product of the lengths
        small = length.max(initial=0) * size.max(initial=0) < EXACT / 2
        score, at = np.zeros((len(part), 0), np.int64), np.zeros((len(part), 0), np.int64)
        least = np.full((len(part), 1), -np.inf)
        for b in range(0, len(x), PART):
            slack = 1e-9 * (1 + length * size[b])
            if (length * size[b] + slack < least).all():
                break  # nor can any shorter row reach it
            alive = np.ones((len(part), len(x[b : b + PART])), bool)
            held = np.flatnonzero((mine >= b) & (mine < b + PART))
            alive[held, mine[held] - b] = False
            if b:
                for c, level in zip(coarse, levels, strict=True):
                    alive &= c @ level[b : b + PART].T + slack >= least
                    if not alive.any():
                        break
            computed += int(alive.sum())
            if not alive.any():
                continue
            if small and alive.mean() <= 0.05:
                i, j = np.nonzero(alive)
                got = np.einsum("pd,pd->p", part[i], xf[b + j])
            else:  # gathering so many rows costs more than a product of matrices
                every = part @ xf[b : b + PART].T if small else whole @ x[b : b + PART].T
                every[~alive] = LEAST
                # of each row the k best of the part, with all their ties
                least_here = np.partition(every, -k, axis=1)[:, -k, None] if every.shape[1] > k else LEAST
                i, j = np.nonzero(alive & (every >= least_here) & (every >= least))
                got = every[i, j]
            got = got.astype(np.int64)
            score, at = _merged(score, at, i, got, place[b + j], k)
            if score.shape[1] == k:
                low = score[:, -1:].astype(float)
                # a row with fewer than k so far has no least score yet
                least = np.where(at[:, -1:] >= 0, low - np.abs(low) * 1e-15, -np.inf)
        out += [(p[p >= 0], s[p >= 0]) for s, p in zip(score, at, strict=True)]
    return out, computed


def _merged(score: np.ndarray, at: np.ndarray, row: np.ndarray, got: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of what each row has and what comes in, greatest first, ties to the earlier place; place -1 where there are fewer."""
    n = len(at)
    had = at >= 0
    row = np.concatenate([np.nonzero(had)[0], row])
    got, places = np.concatenate([score[had], got]), np.concatenate([at[had], places])
    order = np.lexsort((places, -got, row))
    row, got, places = row[order], got[order], places[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    keep = nth < k
    width = min(k, int(nth.max(initial=-1)) + 1)
    score, at = np.zeros((n, width), np.int64), np.full((n, width), -1)
    score[row[keep], nth[keep]], at[row[keep], nth[keep]] = got[keep], places[keep]
    return score, at


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score long``: over floor(scale * x) of every component, the k
    greatest inner products of each row whose id is divisible by ``every`` with all other rows.

    Vectors that are null, empty or hold null or non-finite numbers take no part, nor do
    rows without an id; only vectors of one length are compared. Repeated rows of an id
    count once. A query with fewer others has them all; an empty table has no result.
    Products are exact whole numbers as long as they fit a long.
    """
    by_task(vectors.sparkSession, 4096)
    rows = usable(vectors).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"), F.size("v").alias("dim"))
    rows = cut(rows)
    asked = F.pmod("vec_id", F.lit(every)) == 0
    n, m = rows.agg(F.count("*"), F.count(F.when(asked, 1))).first()
    xs, qs = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    spread = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    x = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(xs)).cast("int").alias("xb"), spread(qs).alias("qb"), "vec_id", "v")
    q = rows.where(asked).select("dim", spread(xs).alias("xb"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(qs)).cast("int").alias("qb"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))

    def run(queries: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(held):
            held = held.sort_values("vec_id")
            ids, names = held["vec_id"].to_numpy(), queries["query_id"].to_numpy()
            own = np.searchsorted(ids, names)
            own[(own == len(ids)) | (ids[np.minimum(own, len(ids) - 1)] != names)] = -1
            got, _ = search(np.stack(queries["qv"].to_list()), np.stack(held["v"].to_list()), own, k)
            out = [(np.full(len(at), name), ids[at], s) for name, (at, s) in zip(names, got, strict=True)]
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    key = ["dim", "xb", "qb"]
    found = q.groupBy(*key).cogroup(x.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score long")
    return ranked(found, k)


#: DuckDB SQL with the rows of ``top_products(embeddings)``.
TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 64)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON x.vec_id <> q.vec_id AND len(x.v) = len(q.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
