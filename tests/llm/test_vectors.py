"""Vector searches against brute force."""

import numpy as np
import pytest

from corpusloom.llm import ann, topk

from .oracle import frames

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"
ODD = [(None, [1.0] * 8, "", 1), (1000, None, "", 1), (1020, [None] + [1.0] * 7, "", 1), (1040, [float("nan")] * 8, "", 1), (1050, [float("inf")] * 8, "", 1), (1100, [0.0] * 8, "", 1), (0, [], "", 1)]


def data(n, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32)
    x[5:25] = x[4]
    return [(i, [float(a) for a in v], "s", 1) for i, v in enumerate(x, 1)]


def test_top_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rows = data(300)
    got = topk.top_products(spark.createDataFrame(rows + [rows[39]] + ODD, SCHEMA).repartition(3), 20, 20).collect()
    v = {i: np.floor(64 * np.array(e, float)) for i, e, *_ in rows} | {1100: np.zeros(8)}
    want = []
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_products(spark.createDataFrame([], SCHEMA)).collect() == []


def test_top_products_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART", 4)
    for n in (1, 2, 19, 20, 21, 22):
        rows = [(20 * i, [float((i * 7 + d * 3) % 11 - 5) for d in range(4)], "", 1) for i in range(n)]
        got = sorted(tuple(r) for r in topk.top_products(spark.createDataFrame(rows, SCHEMA)).collect())
        v = {i: np.floor(64 * np.array(e)).astype(int) for i, e, *_ in rows}
        want = [(q, r, i, -s) for q in v for r, (s, i) in enumerate(sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:20], 1)]
        assert got == sorted(want)


def test_search_in_parts(monkeypatch):
    monkeypatch.setattr(topk, "PART", 16)
    monkeypatch.setattr(topk, "AT_ONCE", 8)
    r = np.random.default_rng(3)
    for scale in (50, 1 << 30):  # the latter's products are over what doubles hold
        x = r.integers(-scale, scale, (150, 8))
        x[20:60] = x[20]  # ties
        x[100:] //= 40
        own = np.where(np.arange(30) % 3, np.arange(30), -1)
        got, computed = topk.search(x[:30], x, own, 5)
        assert computed < 30 * 150
        for i, (at, score) in enumerate(got):
            p = [int(a) for a in x.astype(object) @ x[i].astype(object)]
            want = sorted((-p[j], j) for j in range(150) if j != own[i])[:5]
            assert [(-int(s), int(j)) for j, s in zip(at, score)] == want


def test_top_products_sql(spark):
    a, b = frames(spark, "op6_exact_top_k", "/root/testdata/sf0.01")
    assert a == b


def test_ivf_pq_recall_and_ties(spark):
    rows = data(2000, 1)
    got = ann.nearest(spark.createDataFrame(rows + [rows[49]] + ODD, SCHEMA).repartition(3), 5, 50).collect()
    u = {i: np.array(e, float) / np.linalg.norm(np.array(e, float)) for i, e, *_ in rows}
    hit = total = 0
    for q in (i for i in u if i % 50 == 0):
        want = {i for _, i in sorted((-round(float(u[q] @ u[i]), 12), i) for i in u if i != q)[:5]}
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5] and q not in {i for _, i, _ in mine}
        assert all(abs(s - u[q] @ u[i]) < 1e-12 for _, i, s in mine)
        hit, total = hit + len(want & {i for _, i, _ in mine}), total + 5
    assert hit / total >= 0.9
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 2.0], "", 1), (3, [2.0, 1.0], "", 1)], SCHEMA)).collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in few] == [(0, 1, 3, 0.8)]
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clustered_vectors_need_few_cells(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(60, 24))
    x = centres[r.integers(0, 60, 6000)] + 0.15 * r.normal(size=(6000, 24))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = ann.Quantizer(u, 64)
    assert m.probed <= 12  # under a fifth of the table is scored
    rows = [(i, [float(a) for a in v], "s", 1) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA).repartition(4), 5, 50).collect()
    cos = u[::50] @ u.T
    cos[np.arange(120), np.arange(0, 6000, 50)] = -2
    want = {q * 50: set(np.argsort(-c)[:5].tolist()) for q, c in enumerate(cos)}
    assert sum(g.vec_id in want[g.query_id] for g in got) / 600 >= 0.9


def _shapes():
    r = np.random.default_rng(5)
    centres = r.normal(size=(5, 24))
    near = centres[r.integers(0, 5, 4000)] + 1e-3 * r.normal(size=(4000, 24))  # clusters larger than any fixed number of candidates
    apart = centres[r.integers(0, 5, 4000)] + 0.01 * r.normal(size=(4000, 24))
    apart[::50] = r.normal(size=(80, 24))  # queries unlike the rows
    return {"tight": near, "offset": 10 + r.normal(size=(4000, 24)), "apart": apart, "large": 1e200 * r.normal(size=(4000, 8)), "small": 1e-200 * r.normal(size=(4000, 8))}


@pytest.mark.parametrize("shape", ["tight", "offset", "apart", "large", "small"])
def test_ivf_pq_recall_on_other_shapes(spark, shape):
    x = _shapes()[shape]
    rows = [(i, [float(a) for a in v], "s", 1) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA.replace("float", "double")).repartition(4), 5, 50).collect()
    u = x / np.abs(x).max()
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = u[::50] @ u.T
    cos[np.arange(80), np.arange(0, 4000, 50)] = -2
    least = np.sort(cos, axis=1)[:, -5]
    assert len(got) == 400
    assert all(abs(g.score - cos[g.query_id // 50, g.vec_id]) < 1e-12 for g in got)
    assert sum(cos[g.query_id // 50, g.vec_id] >= least[g.query_id // 50] - 1e-14 for g in got) / 400 >= 0.9


def test_copies_among_near_vectors(spark):
    r = np.random.default_rng(6)
    x = np.ones(16) + 1e-3 * r.normal(size=(1500, 16))
    x[:700] = x[0]
    rows = [(i, [float(a) for a in v], "s", 1) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows + rows[:3], SCHEMA.replace("float", "double")).repartition(4), 5, 50).collect()
    of_copies = {(g.query_id, g.rank): g.vec_id for g in got if g.query_id < 700}
    assert of_copies == {(q, k + 1): i for q in range(0, 700, 50) for k, i in enumerate([i for i in range(6) if i != q][:5])}
    assert len(got) == 150


def test_bins_hold_whole_small_cells(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 10)
    assert ann._bins({0: 4, 1: 6, 2: 1, 5: 25, 6: 3, 7: 8}) == {0: (0, 1), 1: (0, 1), 2: (1, 1), 5: (2, 3), 6: (3, 1), 7: (4, 1)}
