"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fitting takes a bounded sample of labelled texts. Terms are all their words and word
prefixes; each sampled text becomes a TF-IDF vector over them, terms weighted by how far
they tell the labels apart too. Examples are laid out in blocks of similar ones. Terms
have posting lists; those of many examples are laid out by block, with their greatest
weight in each. Scoring sums the short lists, looks into the blocks of the highest
bounds and then into all others that can hold a nearer example, so the nearest found are exact. Their votes, weighted by cosine, are calibrated on the examples themselves
with each left out in turn.
"""

from __future__ import annotations

from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import by_task, words
from corpusloom.sources.lineage import cut

#: Labelled texts of either label that are sampled, in expectation.
SAMPLE = 4000
#: Terms that the sampled texts have together, in expectation; the driver and the tasks hold so many.
TERMS = 16_000_000
#: Terms of more than this share of the examples are laid out by block.
COMMON = 1 / 16
#: Nearest examples that vote.
NEAREST = 12
#: Examples in a block of the index.
BLOCK = 128
#: Texts that look into the index together, and blocks that each looks into before bounds decide.
ASKED, FIRST = 256, 4
_PREFIXES = (4, 5)
_SEP = np.zeros(256, bool)
_SEP[:128] = [not chr(c).isalnum() for c in range(128)]


def _terms(texts: pa.Array) -> list[np.ndarray]:
    """Of each row, the hashes of all its words and their prefixes."""
    w, at, *more = words(texts, _PREFIXES, _SEP)
    return [np.concatenate([x[a:b][x[a:b] != 0] for x in (w, *more)]) for a, b in zip(at[:-1], at[1:], strict=True)]


def sample(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``text, y``: of either label at most about ``SAMPLE`` texts, by hash of the id, and
    ``share``, the part of the label's texts that is drawn. Rows without a label, or with
    one other than 0 and 1, are left out; a doc_id labelled twice counts as its greater,
    and copies of a text with one label count once."""
    y = labels.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, min(1.0, SAMPLE / max(1, sizes.get(1, 0)))).otherwise(min(1.0, SAMPLE / max(1, sizes.get(0, 0))))
    drawn = y.withColumn("share", share).where(F.pmod(F.xxhash64("_id", F.lit("toxicity sample")), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    # bounded by twice SAMPLE rows in expectation, so it may travel to the texts
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    return texts.join(F.broadcast(drawn), "_id").groupBy("text", "y", "share").agg(F.min("_id").alias("_id"))


def thinned(counted: DataFrame) -> DataFrame:
    """The sampled texts (``key, term, share``), fewer of them by hash where together they have over ``TERMS`` terms, whatever their lengths."""
    total = counted.agg(F.sum(F.size("term"))).first()[0] or 0
    if total <= TERMS:
        return counted
    part = TERMS / total
    return counted.where(F.pmod(F.xxhash64("key", F.lit("toxicity terms")), F.lit(1 << 30)) < part * (1 << 30)).withColumn("share", F.col("share") * part)


def _tallied(batches):
    for batch in batches:
        got = [np.unique(x, return_counts=True) for x in _terms(batch.column(0))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x.view(np.int64) for x, _ in got], pa.list_(pa.int64())), pa.array([(1 + np.log(n)).astype(np.float32) for _, n in got], pa.list_(pa.float32()))], ["y", "share", "_id", "key", "term", "n"])


def _vectors(terms: np.ndarray, found: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places in the sorted ``terms`` and log-scaled counts, row by row."""
    out = []
    for x in found:
        k = np.searchsorted(terms, x)
        k[k == len(terms)] = 0
        at, n = np.unique(k[terms[k] == x], return_counts=True) if len(terms) else (np.zeros(0, int), np.zeros(0))
        out.append((at, 1 + np.log(n) if len(n) else n))
    return out


class Index:
    """Unit vectors as posting lists; those of common terms are laid out in blocks, with their greatest weight in each, where they are first asked."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, ids: np.ndarray):
        """Of rows of places in the sorted ``terms`` and log-scaled counts, in the order that the blocks take them."""
        self.terms, self.idf = terms, idf
        unit = [(at, self._unit(at, n).astype(np.float32)) for at, n in rows]
        self._fill([len(at) for at, _ in unit], *(np.concatenate([x[k] for x in unit]) for k in (0, 1)), y, weight, ids)

    @classmethod
    def of(cls, terms: np.ndarray, idf: np.ndarray, *flat: np.ndarray) -> Index:
        """The index of unit vectors that are there already: their sizes, and all their places and weights."""
        self = cls.__new__(cls)
        self.terms, self.idf = terms, idf
        self._fill(*flat)
        return self

    def _fill(self, size: np.ndarray, at: np.ndarray, w: np.ndarray, y: np.ndarray, weight: np.ndarray, ids: np.ndarray) -> None:
        size = np.asarray(size, np.int64)
        full = size > 0
        # texts without any of the terms get the share of toxic ones among such
        self.empty = float(((y * weight)[~full].sum() + 0.01) / (weight[~full].sum() + 1))
        self.y, self.weight, self.ids = y[full].astype(float), weight[full].astype(float), ids[full]
        n = int(full.sum())
        self.blocks = -(-n // BLOCK)
        by_term = np.argsort(at, kind="stable")
        self.by = w[by_term]  # of each term, its examples' weights, and the examples
        self.who = np.repeat(np.arange(n, dtype=np.uint16 if n < 1 << 16 else np.int32), size[full])[by_term]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.terms)))])

    @cached_property
    def slot(self) -> np.ndarray:
        """Of each term its place among the common ones, or -1."""
        slot = np.full(len(self.terms), -1, np.int32)
        common = np.flatnonzero(np.diff(self.start) > COMMON * len(self.y))
        slot[common] = np.arange(len(common))
        return slot

    @cached_property
    def lists(self) -> np.ndarray:
        """Of each block, its examples' weights by common term."""
        common = np.flatnonzero(self.slot >= 0)
        lists = np.zeros((self.blocks, len(common), BLOCK), np.float32)
        for k, t in enumerate(common):
            part = slice(self.start[t], self.start[t + 1])
            who = self.who[part].astype(np.int64)
            lists[who // BLOCK, k, who % BLOCK] = self.by[part]
        return lists

    @cached_property
    def most(self) -> np.ndarray:
        return np.ascontiguousarray(self.lists.max(2).T) if self.blocks else np.zeros((0, 0), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("slot", "lists", "most")}

    def _unit(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = n * self.idf[at]
        return w / np.sqrt((w * w).sum())

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples, nearest first, ties to the first."""
        return self.nearest_all([(at, w)], k, np.array([but]))[0]

    def nearest_all(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int, but: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nearest of several vectors; each leaves out the example at its place of ``but``, unless that is negative."""
        return [x for a in range(0, len(asked), ASKED) for x in self._nearest(asked[a : a + ASKED], k, None if but is None else but[a : a + ASKED])]

    def _nearest(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int, but: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        m, width = len(asked), self.blocks * BLOCK
        common, sums = np.zeros((m, len(self.most)), np.float32), np.zeros((m, width), np.float32)
        for i, (at, w) in enumerate(asked):
            slot = self.slot[at]
            common[i, slot[slot >= 0]] = w[slot >= 0]
            rare = at[slot < 0]
            n = self.start[rare + 1] - self.start[rare]
            read = np.repeat(self.start[rare + 1] - np.cumsum(n), n) + np.arange(n.sum())
            sums[i] = np.bincount(self.who[read], np.repeat(w[slot < 0], n) * self.by[read], width)
        bound = sums.reshape(m, self.blocks, BLOCK).max(2) + common @ self.most
        cos = np.full((m, width), -1, np.float32)

        def look(wanted: np.ndarray) -> np.ndarray:
            """Fills in the wanted blocks; the k-th best cosine so far, or 0."""
            for b in np.flatnonzero(wanted.any(0)):
                i, s = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                cos[i, s] = sums[i, s] + common[i] @ self.lists[b]
            if but is not None:
                cos[np.flatnonzero(but >= 0), but[but >= 0]] = -1
            return np.maximum(np.partition(cos, -k, 1)[:, -k], 0) if width >= k else np.zeros(m, np.float32)

        # the blocks of the highest bounds, then all others that can hold a nearer example
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, 1, kind="stable")[:, :FIRST], True, 1)
        least = look(first)
        least = look(~first & (bound > 0) & (bound >= least[:, None] - 1e-6))
        out = []
        for x, low in zip(cos, least, strict=True):
            near = np.flatnonzero(x > max(low - 1e-6, 0))
            near = near[np.lexsort((near, -np.round(x[near], 6)))[:k]]
            out.append((near, x[near].astype(float)))
        return out

    def vote(self, near: tuple[np.ndarray, np.ndarray]) -> list[float]:
        at, cos = near
        w = cos * self.weight[at]
        return [1.0, float((w * self.y[at]).sum() / w.sum()) if len(at) else 0.0, float(cos[0]) if len(at) else 0.0]

    def score_all(self, rows: list[tuple[np.ndarray, np.ndarray]], curve: np.ndarray) -> list[tuple[float, list[int]]]:
        """Score and evidence of rows of places and log-scaled counts."""
        full = [k for k, (at, _) in enumerate(rows) if len(at) and len(self.y)]
        out: list[tuple[float, list[int]]] = [(self.empty, [])] * len(rows)
        for k, near in zip(full, self.nearest_all([(rows[k][0], self._unit(*rows[k])) for k in full], NEAREST), strict=True):
            p = float(1 / (1 + np.exp(-np.clip(np.dot(self.vote(near), curve), -30, 30))))
            out[k] = p, [int(x) for x in self.ids[near[0]]]
        return out


class Model(NamedTuple):
    """An index that has been sent to the executors, and the curve from its votes to scores."""

    index: Broadcast
    curve: np.ndarray


def _curve(v: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A logistic curve from votes to labels."""
    beta = np.array([-3.0, 6.0, 0.0])
    if not len(v):
        return beta
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(v @ beta, -30, 30)))
        slope = (v * (weight * (p - y))[:, None]).sum(0) + 1e-2 * beta
        curve = (v * (weight * p * (1 - p))[:, None]).T @ v + 1e-2 * np.eye(3)
        step = np.linalg.solve(curve, slope)
        beta = beta - step
        if abs(step).max() < 1e-9:
            break
    return beta


def _lexicon(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All terms of the sampled texts, sorted, and their weights."""
    total, n1 = (float(x or 0) for x in counted.agg(F.count("*"), F.sum("y")).first())
    n0 = total - n1
    got = counted.select("y", F.explode("term").alias("term")).groupBy("term").agg(F.sum("y").cast("int").alias("a"), F.count("*").cast("int").alias("n")).toArrow()
    terms, a, n = got["term"].to_numpy().view(np.uint64), got["a"].to_numpy().astype(float), got["n"].to_numpy().astype(float)
    order = np.argsort(terms)
    terms, a, n = terms[order], a[order], n[order]
    b = n - a
    odd = a * (n0 - b) - b * (n1 - a)
    # the correlation of term and label (chi-squared per text is its square), never 0
    told = np.abs(odd) / np.sqrt((a + b) * (total - a - b + 1) * (n1 + 1) * (n0 + 1)) + 1 / (1 + total)
    return terms, (np.log((1 + total) / (1 + a + b)) + 1) * told


def _units(counted: DataFrame, terms: np.ndarray, idf: np.ndarray) -> DataFrame:
    """The sampled texts as unit vectors: ``top`` their heaviest term, ``at`` the places of all, ``w`` the weights."""
    shared = counted.sparkSession.sparkContext.broadcast((terms, idf))  # as large as the distinct terms of the bounded sample

    def run(batches):
        terms, idf = shared.value
        for batch in batches:
            at = [np.searchsorted(terms, x.values.to_numpy().view(np.uint64)).astype(np.int32) for x in batch["term"]]
            w = [n.values.to_numpy() * idf[k] for k, n in zip(at, batch["n"], strict=True)]
            w = [(x / np.sqrt((x * x).sum())).astype(np.float32) if len(x) else x for x in w]
            top = [int(k[x.argmax()]) if len(k) else -1 for k, x in zip(at, w, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("y", "share", "_id", "key")), pa.array(top, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(w, pa.list_(pa.float32()))], ["y", "share", "_id", "key", "top", "at", "w"])

    return counted.mapInArrow(run, "y int, share double, _id long, key long, top int, at array<int>, w array<float>")


def _votes(units: DataFrame, shared: Broadcast, keys: np.ndarray) -> DataFrame:
    """Of each vector the votes of the nearest others, ``share`` and ``cos``; ``keys`` names the examples by their places."""
    order = np.argsort(keys)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.greater_equal(batch["top"], 0))
            index, own = shared.value, order[np.searchsorted(keys, batch["key"].to_numpy(), sorter=order)]
            asked = [(a.values.to_numpy(), w.values.to_numpy()) for a, w in zip(batch["at"], batch["w"], strict=True)]
            v = [index.vote(near) for near in index.nearest_all(asked, NEAREST, own)]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["y"], batch["share"], *(pa.array([x[k] for x in v], pa.float64()) for k in (1, 2))], ["key", "y", "share", "toxic", "cos"])

    return units.mapInArrow(run, "key long, y int, share double, toxic double, cos double")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The index of a bounded sample of ``docs`` (doc_id, text) that ``labels`` (doc_id, label) marks.

    Tasks count terms, weigh vectors and let them vote; the driver holds the sampled
    vectors once, as posting lists, until they are sent. The sample has at most about
    ``SAMPLE`` texts of a label and ``TERMS`` terms in all, so its size doesn't follow the table.

    Null texts and labels other than 0 and 1 teach nothing; copies of a text count once and
    ties of cosine go to the first. Without any example every text gets the score that
    texts without a known term get. Columns beside those named don't matter."""
    by_task(docs.sparkSession)
    drawn = sample(docs, labels, label).select("text", "y", "share", "_id", F.xxhash64("text", "y").alias("key"))
    counted = thinned(cut(drawn.mapInArrow(_tallied, "y int, share double, _id long, key long, term array<long>, n array<float>")))
    terms, idf = _lexicon(counted)
    # texts of the same heaviest term stand together, so that blocks differ
    units = cut(_units(counted, terms, idf).orderBy("top", "_id", "key"))
    got = units.toArrow()
    y, share, ids, keys, top = (got[c].to_numpy() for c in ("y", "share", "_id", "key", "top"))
    index = Index.of(terms, idf, pc.list_value_length(got["at"]).to_numpy(), pc.list_flatten(got["at"]).to_numpy(), pc.list_flatten(got["w"]).to_numpy(), y, 1 / share, ids)
    del got
    shared = docs.sparkSession.sparkContext.broadcast(index)
    del index
    pa.default_memory_pool().release_unused()
    v = _votes(units, shared, keys[top >= 0]).orderBy("key").toArrow()
    v, y, share = np.stack([np.ones(len(v)), v["toxic"].to_numpy(), v["cos"].to_numpy()], 1), v["y"].to_numpy(), v["share"].to_numpy()
    return Model(shared, _curve(v, y, 1 / share))


def score(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``evidence``,
    the ids of the examples that voted, nearest first.

    Null and empty texts, and texts without a term of the examples, get the toxic share of such
    examples and no evidence; repeated rows are scored alike.
    """
    by_task(docs.sparkSession)
    kept = docs.select(F.col("text").cast("string"), *keep)

    def run(batches):
        index = model.index.value
        for batch in batches:
            got = index.score_all(_vectors(index.terms, _terms(batch.column(0))), model.curve)
            p = [x for x, _ in got]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([x for _, x in got], pa.list_(pa.int64()))], [*batch.schema.names[1:], "score", "predicted", "evidence"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[1:])
    return kept.mapInArrow(run, f"{schema}score double, predicted int, evidence array<bigint>")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, columns as they were.

    Null and empty texts are scored like texts without a known term; repeated rows all stay or
    all go; an empty table stays empty."""
    by_task(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        index = model.index.value
        for batch in batches:
            found = _vectors(index.terms, _terms(batch.column(at).cast(pa.string())))
            yield batch.filter(pa.array([p < 0.5 for p, _ in index.score_all(found, model.curve)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
