"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Words are counted over all training texts. Every word has a leaf in a tree of classes,
``WAYS`` to a class: the most frequent words one each, ordered so that words of like
predecessors share classes; all others a leaf by their first two bytes, which they share.
A word's probability is the product of one softmax for each class on its path, over
hashed features of what went before (the last word, the last two, and the words two and
three back), and in a shared leaf its smoothed share of the counts there.

The tree grows with the number of distinct words, up to ``LEVELS`` levels. Training
sweeps all training texts once, in rounds: each task makes gradient updates of its own
from the weights of the last round, and each touched row's changes are averaged by how
often the tasks touched it. So scores depend, within the noise of such averages, on how
the table is cut into partitions; the same table in the same partitions is scored alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import by_task, mix, words
from corpusloom.sources.lineage import cut

#: Classes of a class; of the root's, those of words with leaves of their own.
WAYS, OWN = 16, 12
#: Levels of the tree at most: 4 give 49,152 words leaves of their own, and others 16,384.
LEVELS = 4
#: Words whose counts travel to every task; the counts of others are joined.
FREQUENT = 1 << 17
#: Rows of features in the weights of a level.
ROWS = 1 << 15
#: Rounds of a sweep, tokens in an update, rate of learning.
ROUNDS, BATCH, RATE = 2, 32_768, 0.09
#: Tokens that a task learns from at least, if there are so many: a task sends its changes once a round.
PER_TASK = 500_000
#: Weight of the plain class shares beside each softmax.
FLOOR = 0.02
#: Partial results of a round that one task averages, and parts that the rows of a level are dealt into.
FAN_IN, SHARDS = 32, 16
#: Predecessors that words are compared by: this many frequent ones, and others by hash.
NEAR, NEAR_HASHED = 24, 8
END = np.uint64(0x5EED0E4D)
_U = np.uint64
_SHIFT = _U(64 - 15)


@dataclass
class Model:
    """What is learned; its size doesn't depend on the corpus."""

    total: int  # training tokens
    distinct: int
    depth: int  # levels of the tree
    frequent: np.ndarray  # sorted hashes
    counts: np.ndarray  # of these
    leaf: np.ndarray  # of these, or -1 if it goes by the first bytes
    shared: np.ndarray  # log10 denominators of the shared leaves
    shares: list[np.ndarray]  # by level: each class's share of the class above it
    tables: list[np.ndarray]  # by level: weights by row of a feature, then by class above

    @property
    def own(self) -> int:
        """Leaves of single words; the shared ones follow."""
        return OWN * WAYS ** (self.depth - 1)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens and of their first two bytes, their place in the text, and the index of the text."""
    w, at, two = words(texts, (2,))
    n = np.diff(at) + 1
    doc = np.repeat(np.arange(len(n)), n)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
    pos = np.arange(len(doc)) - first[doc] if len(n) else np.zeros(0, np.int64)
    last = pos == n[doc] - 1 if len(n) else np.zeros(0, bool)
    seq = np.full(len(doc), END, np.uint64)
    kind = np.zeros(len(doc), np.int64)
    seq[~last] = w
    kind[~last] = (np.where(two != 0, two, w) >> _U(34)).astype(np.int64)
    return seq, kind, pos, doc


def features(seq: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Hashes of the four features of each token's past."""
    back = []
    for k in (1, 2, 3):
        b = np.zeros(len(seq), np.uint64)
        b[k:] = seq[:-k]
        b[pos < k] = k
        back.append(b)
    return [back[0] * _U(0x9E3779B97F4A7C15), mix(back[0] * _U(0xC2B2AE3D27D4EB4F) + back[1], 22), mix(back[1], 23), mix(back[2], 24)]


def level_rows(f: list[np.ndarray], above: np.ndarray, level: int) -> list[np.ndarray]:
    """The rows of a level's table that a token's features and the class above it name."""
    if not level:
        return [(x >> _SHIFT).astype(np.int64) for x in f] + [np.full(len(above), ROWS)]
    a = above.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(level)
    return [(((x ^ a) * _U(0x9E6C63D0876A9A35)) >> _SHIFT).astype(np.int64) for x in (f[0], f[2])] + [ROWS + above]


def _softmax(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Class probabilities of each token, from the sums of its rows."""
    z = np.take(table, rows[0], axis=0)
    part = np.empty_like(z)
    for r in rows[1:]:
        np.take(table, r, axis=0, out=part, mode="clip")
        z += part
    np.clip(z, -60, 60, out=z)  # far from what a float overflows at
    np.exp(z, out=z)
    z *= 1 / (z @ np.ones((z.shape[1], 1), np.float32))
    return z


class _Learner:
    """Adagrad on one table of weights."""

    def __init__(self, table: np.ndarray):
        self.start, self.table = table, table.copy()
        self.seen, self.speed = np.zeros(len(table), np.float32), np.full(len(table), 1e-2, np.float32)

    def step(self, rows: list[np.ndarray], y: np.ndarray) -> None:
        g = _softmax(self.table, rows)
        g[np.arange(len(y)), y] -= 1
        if rows[-1][0] == ROWS and (rows[-1] == ROWS).all():  # a row for all tokens needs no sorting
            self._move(rows[-1][:1], g.sum(0, keepdims=True), np.array([len(y)]))
            rows = rows[:-1]
        flat = np.concatenate(rows)
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        # pairs of columns are summed together, as the parts of complex numbers
        sums = np.add.reduceat(np.take(g, order % len(y), axis=0).view(np.complex64), first, axis=0).view(np.float32)
        self._move(flat[first], sums, np.diff(np.append(first, len(flat))))

    def _move(self, at: np.ndarray, sums: np.ndarray, times: np.ndarray) -> None:
        self.speed[at] += np.einsum("rc,rc->r", sums, sums) / sums.shape[1]
        self.table[at] -= sums * (RATE / np.sqrt(self.speed[at]))[:, None]
        self.seen[at] += times


def _looked_up(model: Model, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the list of frequent words, and whether the word is there."""
    if not len(model.frequent):
        return np.zeros(len(seq), np.int64), np.zeros(len(seq), bool)
    at = np.minimum(np.searchsorted(model.frequent, seq), len(model.frequent) - 1)
    return at, model.frequent[at] == seq


def leaves(model: Model, kind: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The leaf of each token."""
    others = model.own + kind % (WAYS**model.depth - model.own)
    if not len(model.leaf):
        return others
    leaf = model.leaf[at]
    return np.where(known & (leaf >= 0), leaf, others)


def _count(batches):
    for batch in batches:
        seq, kind, _, _ = tokens(batch.column(0))
        w, at, n = np.unique(seq, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n, pa.int64()), pa.array(kind[at], pa.int32())], ["w", "n", "kind"])


def count(docs: DataFrame) -> DataFrame:
    """``w, n, kind``: each training token's hash, count and hash of the first two bytes; end of text included."""
    by_task(docs.sparkSession)
    return cut(docs.select(F.col("text").cast("string")).mapInArrow(_count, "w long, n long, kind int").groupBy("w").agg(F.sum("n").alias("n"), F.min("kind").alias("kind")))


_PARTIAL = "shard int, task long, at binary, seen binary, mean binary"


def _sent(level: int, task: int, seen: np.ndarray, mean: np.ndarray) -> list[tuple]:
    """The touched rows of a table as ``_PARTIAL``, in ``SHARDS`` parts: row numbers, times touched, and what is to be averaged."""
    at = np.flatnonzero(seen)
    parts = np.split(at, np.searchsorted(at * SHARDS // max(1, len(seen)), np.arange(1, SHARDS)))
    return [(level * SHARDS + s, task, a.astype(np.int32).tobytes(), seen[a].astype(np.float32).tobytes(), mean[a].astype(np.float16).tobytes()) for s, a in enumerate(parts) if len(a)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["shard", "task", "at", "seen", "mean"])


def _rows(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, times and means of several partial results of one table, added up."""
    at, seen = (np.concatenate([np.frombuffer(b, d) for b in group[c]]) for c, d in (("at", np.int32), ("seen", np.float32)))
    mean = np.concatenate([np.frombuffer(m, np.float16).reshape(len(a) // 4, -1) for a, m in zip(group["at"], group["mean"], strict=True)])
    rows, to = np.unique(at, return_inverse=True)
    total = np.bincount(to, seen)
    return rows, total, np.stack([np.bincount(to, seen * c) for c in mean.T.astype(np.float32)], 1) / total[:, None]


def _averaged(parts: DataFrame, tasks: int) -> pd.DataFrame:
    """Partial results averaged by how often rows were touched, ``FAN_IN`` at a time, until there is one of each shard."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        at, seen, mean = _rows(group)
        key = int(group["shard"].iloc[0]), int(group["task"].iloc[0]) // FAN_IN
        return pd.DataFrame([(*key, at.astype(np.int32).tobytes(), seen.astype(np.float32).tobytes(), mean.astype(np.float16).tobytes())], columns=["shard", "task", "at", "seen", "mean"])

    while tasks > 1:
        parts = parts.groupBy("shard", F.floor(F.col("task") / FAN_IN).alias("_to")).applyInPandas(add, _PARTIAL)
        tasks = -(-tasks // FAN_IN)
    return parts.toPandas()  # as large as the averaged tables


def _tasked(docs: DataFrame, total: int) -> tuple[DataFrame, int]:
    """``text, task`` in so many partitions that each has about ``PER_TASK`` of ``total`` tokens, or as many as before; and their number."""
    docs = docs.coalesce(max(1, total // PER_TASK))
    return docs.select(F.col("text").cast("string"), F.spark_partition_id().cast("long").alias("task")), docs.rdd.getNumPartitions()


def predecessors(docs: DataFrame, head: np.ndarray, total: int) -> np.ndarray:
    """For each of the words, most frequent first, the shares of its predecessors: each of the first ``NEAR`` words, and all others by hash."""
    order = np.argsort(head)
    shared = docs.sparkSession.sparkContext.broadcast((head[order], order))
    width = NEAR + NEAR_HASHED

    def met(batches):
        by_hash, place = shared.value
        n, task = np.zeros(len(by_hash) * width, np.float32), -1
        for batch in batches:
            if len(batch):
                task = batch.column(1)[0].as_py()
                seq, _, pos, _ = tokens(batch.column(0))
                i = np.minimum(np.searchsorted(by_hash, seq), len(by_hash) - 1)
                rank = np.where(by_hash[i] == seq, place[i], -1)
                near = np.where((rank >= 0) & (rank < NEAR), rank, NEAR + (seq % _U(NEAR_HASHED)).astype(np.int64))
                ok = np.flatnonzero((rank >= 0) & (pos > 0))
                np.add.at(n, rank[ok] * width + near[ok - 1], np.float32(1))
        if task >= 0:
            n = n.reshape(-1, width)
            times = n.sum(1)
            yield _batch(_sent(0, task, times, n / np.maximum(times, 1)[:, None]))

    out = np.zeros((len(head), width))
    text, tasks = _tasked(docs, total)
    got = _averaged(text.mapInArrow(met, _PARTIAL), tasks)
    if len(got):
        at, _, mean = _rows(got)
        out[at] = mean
    return out


def ordered(near: np.ndarray) -> np.ndarray:
    """An order of the rows in which like ones stand together: halved along the direction of most variance, again and again."""
    out, todo = [], [np.arange(len(near))]
    while todo:
        part = todo.pop()
        if len(part) <= WAYS:
            out.append(part)
            continue
        x = near[part] - near[part].mean(0)
        by = part[np.lexsort((part, x @ np.linalg.eigh(x.T @ x)[1][:, -1]))]
        todo += [by[len(by) // 2 :], by[: len(by) // 2]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sweep(docs: DataFrame, model: Model) -> Model:
    """One round: local updates from the given weights, averaged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def learn(batches):
        m = shared.value
        learners = [_Learner(t) for t in m.tables]
        held: list[tuple] = []
        task = -1

        def flush(whole: bool) -> None:
            nonlocal held
            if not held:
                return
            *f, leaf = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(leaf) if whole else len(leaf) // BATCH * BATCH
            for a in range(0, end, BATCH):
                s = slice(a, min(a + BATCH, end))
                for level, learner in enumerate(learners):
                    path = leaf[s] // WAYS ** (m.depth - 1 - level)
                    learner.step(level_rows([x[s] for x in f], path // WAYS, level), path % WAYS)
            held = [(*(x[end:] for x in f), leaf[end:])] if end < len(leaf) else []

        for batch in batches:
            if len(batch):
                task = batch.column(1)[0].as_py()
                seq, kind, pos, _ = tokens(batch.column(0))
                held.append((*features(seq, pos), leaves(m, kind, *_looked_up(m, seq))))
                flush(False)
        flush(True)
        if task >= 0:
            yield _batch([r for level, x in enumerate(learners) for r in _sent(level, task, x.seen, x.table - x.start)])

    text, tasks = _tasked(docs, model.total // ROUNDS)
    got = _averaged(text.mapInArrow(learn, _PARTIAL), tasks)
    tables = [t.copy() for t in model.tables]
    for level, t in enumerate(tables):
        mine = got[got["shard"] // SHARDS == level]
        if len(mine):
            at, _, mean = _rows(mine)
            t[at] += mean.astype(np.float32)
    return Model(**{**model.__dict__, "tables": tables})


def _top(counts: DataFrame) -> pd.DataFrame:
    """``w, n``, most frequent first: all words from some count on, so many that they are ``FREQUENT`` at most."""
    scale = F.floor(F.log2("n") * 16)  # a row comes from each sixteenth of a doubling
    many, least = 0, None
    for r in counts.groupBy(scale.alias("at")).agg(F.count("*").alias("many")).orderBy(F.desc("at")).collect():
        many += r["many"]
        if many > FREQUENT:
            break
        least = r["at"]
    return counts.where(scale >= least if least is not None else F.lit(False)).select("w", "n").toPandas().sort_values(["n", "w"], ascending=[False, True])


def start(docs: DataFrame, counts: DataFrame) -> Model:
    """The tree of classes, with weights by counts alone."""
    total, distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
    depth = 2
    while depth < LEVELS and OWN * WAYS ** (depth - 1) < distinct:
        depth += 1
    every, own = WAYS**depth, OWN * WAYS ** (depth - 1)
    top = _top(counts)
    w, n = top["w"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    head = w[:own]
    leaf = np.full(len(w), -1)
    mass = np.zeros(every)  # counts by leaf
    mass[own:] = 0.5  # for a word not met yet
    rest = counts
    if len(head):
        # spread over all leaves, so that each class has its part of the words
        leaf[ordered(predecessors(docs, head, total))] = np.arange(len(head)) * own // len(head)
        mass[leaf[: len(head)]] = n[: len(head)]
        rest = counts.join(F.broadcast(docs.sparkSession.createDataFrame(top[["w"]][:own])), "w", "left_anti")
    shared = np.full(every - own, math.log10(0.5))
    for r in rest.groupBy((F.col("kind") % (every - own)).alias("at")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[own + r["at"]] = r["n"] + 0.5 * (r["v"] + 1)
        shared[r["at"]] = math.log10(mass[own + r["at"]])
    shares, tables = [], []
    for level in range(depth):
        by_class = mass.reshape(WAYS**level, WAYS, -1).sum(2)
        share = by_class / np.maximum(by_class.sum(1, keepdims=True), 0.5)
        table = np.zeros((ROWS + len(share), WAYS), np.float32)
        table[ROWS:] = np.where(share > 0, np.log(np.maximum(share, 1e-12)), -30)
        tables.append(table)
        shares.append(share.ravel())
    order = np.argsort(w)
    return Model(total, distinct, depth, w[order], n[order], leaf[order], shared, shares, tables)


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """A model of all texts of ``docs`` (doc_id, text), given their ``count``."""
    by_task(docs.sparkSession)
    model = start(docs, counts)
    for k in range(ROUNDS):
        model = _sweep(docs.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)) == k), model)
    return model


def log10_path(model: Model, f: list[np.ndarray], leaf: np.ndarray) -> np.ndarray:
    """The log10 probability of each token's leaf."""
    p = np.ones(len(leaf))
    for level, table in enumerate(model.tables):
        path = leaf // WAYS ** (model.depth - 1 - level)
        chosen = _softmax(table, level_rows(f, path // WAYS, level))[np.arange(len(leaf)), path % WAYS]
        p *= (1 - FLOOR) * chosen + FLOOR * model.shares[level][path]
    return np.log10(p)


def score(docs: DataFrame, model: Model, counts: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` columns, ``n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the log10 probability by counts alone, ``score`` the model's. Null
    and empty texts have the end alone. Repeated rows are scored alike; an empty table
    gives an empty result; without training texts nothing is known. Texts of any length
    are scored whole; other columns don't matter.
    """
    by_task(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col("text").cast("string"), F.struct(*keep).alias("keep"), F.monotonically_increasing_id().alias("row"))

    def run(batches):
        m = shared.value
        log_counts = np.log10(m.counts + 0.5)
        for batch in batches:
            n = len(batch)
            seq, kind, pos, doc = tokens(batch.column(0))
            at, known = _looked_up(m, seq)
            leaf = leaves(m, kind, at, known)
            logc = np.where(known, log_counts[at], 0.0) if len(log_counts) else np.zeros(len(seq))
            p, f = np.zeros(len(seq)), features(seq, pos)
            for a in range(0, len(seq), BATCH):
                s = slice(a, a + BATCH)
                p[s] = log10_path(m, [x[s] for x in f], leaf[s])
            among = np.flatnonzero(leaf >= m.own)
            p[among] += logc[among] - m.shared[leaf[among] - m.own]
            rare = ~known
            sums = [np.bincount(doc, weights=x, minlength=n)[:n] for x in (np.ones(len(seq)), known, logc, p)]
            ends = np.searchsorted(doc[rare], np.arange(n + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(seq[rare].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(x) for x in sums), lists], ["keep", "row", "tokens", "known", "logc", "p", "rare"])

    schema = f"keep {kept.schema['keep'].dataType.simpleString()}, row long, tokens double, known double, logc double, p double, rare array<bigint>"
    rows = cut(kept.mapInArrow(run, schema))
    rare = rows.select("row", F.explode("rare").alias("w")).groupBy("row", "w").agg(F.count("*").alias("times"))
    c = F.coalesce("n", F.lit(0))
    more = rare.join(counts.select("w", "n"), "w", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("found"))
    base = math.log10(model.total + 0.5 * (model.distinct + 1))
    more_c, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return rows.drop("rare").join(more, "row", "left").select(
        "keep.*",
        F.col("tokens").cast("long").alias("n_tokens"),
        (F.col("known").cast("long") + found).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logc") + more_c - F.col("tokens") * base).alias("base_score"),
        (F.col("p") + more_c).alias("score"),
    )
