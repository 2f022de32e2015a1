"""Hard negatives against brute force, and the intervals against exact scores."""

import numpy as np
import pytest

from corpusloom.llm import negatives as neg

from .oracle import frames

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, code string"


def brute(rows, every=100, k=5, percent=80):
    """Plain loops over ``vec_id, vector, label``."""
    v = {i: [int(np.floor(256 * float(np.float32(a)))) for a in x] for i, x, _ in rows}
    label, out = {i: y for i, _, y in rows}, []
    dot = lambda a, b: sum(p * q for p, q in zip(v[a], v[b], strict=True))
    for a in sorted(i for i in v if i % every == 0):
        others = sorted((-dot(a, i), i) for i in v if i != a and len(v[i]) == len(v[a]))
        for p, pid in [(-s, i) for s, i in others if label[i] == label[a]][:k]:
            fit = [(-s, i) for s, i in others if label[i] != label[a] and percent * p <= -100 * s <= 100 * p][:k]
            out += [(a, pid, r, i, p, s) for r, (s, i) in enumerate(fit, 1)]
    return out


def data(n, dim=12, seed=0, labels=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x[5:60] = x[4]  # ties
    x[60:90] = x[4] * r.uniform(0.75, 1.0, (30, 1))
    return [(i, [float(a) for a in v], int(r.integers(labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("dim", [1, 12, 64, 100])
def test_hard_negatives(spark, monkeypatch, dim):
    monkeypatch.setattr(neg, "BLOCK", 128)
    monkeypatch.setattr(neg, "ANCHORS", 8)
    monkeypatch.setattr(neg, "AT_ONCE", 4)
    rows = data(500, dim, dim)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA).repartition(3)
    got = neg.hard_negatives(df, every=20).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, 20))
    assert len(got) > 100


def test_odd_rows(spark):
    rows = data(95, 8, 4)
    odd = [(None, [1.0] * 8, 1), (1000, None, 1), (1020, [1.0] * 8, None), (1040, [None] + [1.0] * 7, 1), (1060, [float("nan")] * 8, 1), (1080, [float("-inf")] * 8, 1)]
    more = [(1100 + i, [0.0] * 8, i % 2) for i in range(8)] + [(1120 + 5 * i, [], i % 2) for i in range(8)] + [(1200 + 5 * i, [float(i), 1.0, 2.0], i % 2) for i in range(9)] + [(-20, [1.0] * 8, 0)]
    # copies of a row, and an id with another vector of a greater label
    again = [rows[20], rows[20], (rows[20][0], [9.0] * 8, 7)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + odd + more + again], SCHEMA).repartition(3)
    got = neg.hard_negatives(df, every=20).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows + more, 20))
    for few in ([], rows[:1], rows[:2]):
        assert neg.hard_negatives(spark.createDataFrame([(*r, 1, "c") for r in few], SCHEMA)).collect() == sorted(brute(few))


def test_large_numbers_and_a_hot_vector(spark):
    rows = [(i, [1e6 + i % 3, -2e6, 3e6 * (i % 5)], i % 2) for i in range(400)] + [(400 + i, [1.0, 2.0, 3.0], i % 2) for i in range(400)]
    got = neg.hard_negatives(spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


@pytest.mark.parametrize("dim", [3, 64, 200])
def test_intervals_hold_scores_and_narrow(dim):
    r = np.random.default_rng(dim)
    x = np.floor(256 * r.normal(size=(400, dim))).astype(np.int64)
    x[7] = 0
    x[8:20] = x[3] * 2
    asked, codes, exact = neg.Asked.of(x[:40]), neg.Codes.of(x), (x[:40] @ x.T).astype(float)
    width = []
    for low, high in neg.intervals(asked, codes, slice(0, 40)):
        assert (low <= exact).all() and (exact <= high).all()
        width.append((high - low).mean())
    assert all(b < a for a, b in zip(width, width[1:], strict=False))


def test_intervals_leave_few_pairs():
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(3000, 64)) / 8).astype(np.int64)
    names, kinds = np.arange(3000), r.integers(0, 10, 3000)
    codes = neg.Codes.of(x)
    found, scored = neg.best_of_label(names[:30], kinds[:30], x[:30], names, kinds, x, codes, 5)
    assert scored < 0.02 * 30 * 3000
    caps = [np.unique(np.concatenate([s[a == i] for a, _, s in found])) for i in range(30)]
    _, scored = neg.best_below(names[:30], kinds[:30], x[:30], caps, names, kinds, x, codes, 5, 80)
    assert scored < 0.12 * 30 * 3000


def test_rotations_keep_products():
    x = np.random.default_rng(0).normal(size=(20, 128))
    y = neg.rotated(x, 2)
    assert np.allclose(x @ x.T, y @ y.T) and not np.allclose(x, y)


def test_op11_sql(spark):
    a, b = frames(spark, "op11_hard_negatives", "/root/testdata/sf0.01")
    assert a == b and a
