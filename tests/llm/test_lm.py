"""Language-model scores: the base against plain counts, the model on held-out texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lm

SCHEMA = "doc_id long, text string, score string, keep int"


def toks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def texts(n, seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a, t = r.randrange(40), []
        for _ in range(r.randrange(5, 80)):
            t.append(f"w{a}x" if r.random() < 0.9 else f"R{r.randrange(5000)}")
            a = (a * 7 + 3 + (r.random() < 0.1)) % 40
        out.append(" ".join(t))
    return out + [None, "", " \n"]


def test_base_and_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 60)
    monkeypatch.setattr(lm, "BATCH", 256)
    rows = [(i, t, "s", 1) for i, t in enumerate(texts(400))]
    docs = spark.createDataFrame([*rows, rows[5], (None, "w1x", None, None)], SCHEMA).repartition(3)
    learned = docs.where("doc_id < 300")
    counts = lm.count(learned)
    model = lm.train(learned, counts)
    got = lm.score(docs, model, counts, F.col("doc_id")).collect()
    assert len(got) == len(rows) + 2
    c = Counter(x for i, t, *_ in [*rows, rows[5]] if i < 300 for x in toks(t))
    n = sum(c.values())
    for r in got:
        t = toks(rows[r.doc_id][1] if r.doc_id is not None else "w1x")
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (len(c) + 1))) for x in t), abs=1e-6)
        assert math.isfinite(r.score) and r.score < 0
    held = [r for r in got if (r.doc_id or 0) >= 300]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.9


def plain_score(m, text, count):
    """A text's score, word by word, class by class, with sums of plain numbers."""
    seq, kind, pos, _ = lm.tokens(pa.array([text], pa.string()))
    f = lm.features(seq, pos)
    leaf = lm.leaves(m, kind, *lm._looked_up(m, seq))
    total = 0.0
    for i, x in enumerate(leaf.tolist()):
        for level in range(m.depth):
            path = x // lm.WAYS ** (m.depth - 1 - level)
            rows = [int(r[i]) for r in lm.level_rows(f, leaf // lm.WAYS ** (m.depth - level), level)]
            z = [sum(float(m.tables[level][r, c]) for r in rows) for c in range(lm.WAYS)]
            p = math.exp(z[path % lm.WAYS]) / sum(map(math.exp, z))
            total += math.log10((1 - lm.FLOOR) * p + lm.FLOOR * m.shares[level][path])
        if x >= m.own:
            total += math.log10(count(int(seq[i])) + 0.5) - m.shared[x - m.own]
    return total


def test_scores_against_plain_sums(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 300)
    monkeypatch.setattr(lm, "BATCH", 256)
    monkeypatch.setattr(lm, "PER_TASK", 1000)
    long = " ".join(f"w{k % 50}x" for k in range(30_000))
    rows = [(i, t, "s", 1) for i, t in enumerate([*texts(300, 2), long])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    learned = docs.where("doc_id < 250")
    counts = lm.count(learned)
    model = lm.train(learned, counts)
    assert model.depth == 3 and len(set(model.leaf[model.leaf >= 0])) == (model.leaf >= 0).sum() > 100
    c = {r.w & (2**64 - 1): r.n for r in counts.collect()}
    got = {r.doc_id: r.score for r in lm.score(docs, model, counts, F.col("doc_id")).collect()}
    for i in (0, 7, 260, 280, 300, 301, 302, 303):
        assert got[i] == pytest.approx(plain_score(model, rows[i][1], lambda w: c.get(w, 0)), rel=1e-4)


def test_words_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts(60, 3))], SCHEMA)
    counts = lm.count(docs)
    m = lm.train(docs, counts)
    f = [np.repeat(x[:1], lm.WAYS**m.depth) for x in lm.features(*lm.tokens(pa.array(["w1x"]))[::2])]
    assert (10 ** lm.log10_path(m, f, np.arange(lm.WAYS**m.depth))).sum() == pytest.approx(1, abs=1e-4)


def test_partial_results_average_by_touches():
    seen, mean = np.array([2.0, 0, 1, 3]), np.arange(8.0).reshape(4, 2)
    parts = lm._sent(0, 0, seen, mean) + lm._sent(0, 1, np.array([2.0, 1, 0, 0]), mean + 1)
    at, times, got = lm._rows(pd.DataFrame(parts, columns=["shard", "task", "at", "seen", "mean"]))
    assert at.tolist() == [0, 1, 2, 3] and times.tolist() == [4, 1, 1, 3]
    assert got.tolist() == [[0.5, 1.5], [3, 4], [4, 5], [6, 7]]


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1)], SCHEMA)
    counts = lm.count(docs.where("false"))
    got = lm.score(docs, lm.train(docs.where("false"), counts), counts, F.col("doc_id")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)]
    assert lm.score(docs.where("false"), lm.train(docs, lm.count(docs)), lm.count(docs), F.col("doc_id")).collect() == []
