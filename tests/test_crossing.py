"""Blocks that meet every other block: whole results, and no pair in a shuffle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import crossing, votes
from corpusloom.operators import ranking as R
from corpusloom.operators import similarity as S
from corpusloom.operators.graph import connected_components
from corpusloom.sources.lineage import cut


def dealt(df):
    """Whether anything is shuffled after the last checkpoint."""
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_two_hop_shuffles_no_pairs(spark, monkeypatch):
    r = random.Random(5)
    links = [(f"p{k}", f"/{r.randrange(40)}") for k in range(90)] + [(f"p{k}", "/hub") for k in range(60)] + [("p1", "p2"), ("p3", "p3"), (None, "/1"), ("p4", None)]
    near = {}
    for a, b in links:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {(x, y) for x in near for m in near[x] for y in {m} | near[m] if y != x}
    df = cut(spark.createDataFrame(links + links[:20], "src string, dst string").repartition(3))
    start = spark.createDataFrame([("p7",), ("/hub",), ("p7",), ("nowhere",)], "node string")
    for nodes, pairs, rows, tasks in ((4096, 4_000_000, 50_000, 128), (10, 7, 3, 2)):
        monkeypatch.setattr(votes, "HOP_NODES", nodes)
        monkeypatch.setattr(votes, "HOP_PAIRS", pairs)
        monkeypatch.setattr(votes, "HOP_ROWS", rows)
        monkeypatch.setattr(crossing, "TASKS", tasks)
        got = votes.two_hop(df)
        assert not dealt(got)
        rows = [tuple(x) for x in got.collect()]
        assert len(rows) == len(want) and set(rows) == want
        assert {tuple(x) for x in votes.two_hop(df, start).collect()} == {(x, y) for x, y in want if x in ("p7", "/hub")}
    assert votes.two_hop(df.where(F.lit(False))).collect() == []


def plain_cosines(v):
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    cos = np.round(u @ u.T, 6)
    np.fill_diagonal(cos, -2)
    return cos


@pytest.fixture
def vectors(spark, monkeypatch):
    """Vectors in blocks of few, some of them equal, in clusters that hold together by little."""
    for name, n in (("BLOCK", 40), ("ASKED", 15), ("AT_ONCE", 16), ("RUN", 5000)):
        monkeypatch.setattr(S, name, n)
    r = np.random.default_rng(4)
    v = r.normal(size=(230, 6)).astype(np.float32)
    v[20:30] = v[20]
    grp = r.integers(0, 7, 230)
    df = spark.createDataFrame([(7 * k, [float(x) for x in row], int(g)) for k, (row, g) in enumerate(zip(v, grp, strict=True))] + [(1, None, 0)], "id long, v array<float>, grp long")
    return cut(df.repartition(5)), plain_cosines(v.astype(float)), grp


@pytest.mark.parametrize("tasks", [1, 128])
def test_pairs_by_blocks(vectors, monkeypatch, tasks):
    monkeypatch.setattr(crossing, "TASKS", tasks)
    df, cos, grp = vectors
    floor, some = 0.3, np.arange(0, 230, 3)
    pairs = S.cosines(df, df, floor, below=True)
    assert not dealt(pairs)
    assert {tuple(x) for x in pairs.collect()} == {(7 * i, 7 * j, cos[i, j]) for i in range(230) for j in range(i + 1, 230) if cos[i, j] >= floor} and pairs.count() == pairs.distinct().count()
    best = S.cosines(df.where("id % 21 = 0"), df, floor, 9)
    assert not dealt(best)
    want = {(7 * i, 7 * j, k) for i in some for k, j in enumerate(np.lexsort((np.arange(230), -cos[i]))[:9]) if cos[i, j] >= floor}
    assert {(x.query_id, x.id, x["rank"]) for x in S.top(best, 9).collect()} == want
    if tasks == 1:  # what a task has found so far bounds what leaves it
        assert best.count() == len(want)
    sums = S.sums_by_group(df, df.withColumn("more", F.col("grp") + 10), floor, "grp", "more")
    got = {(x.query_id, x.grp): (round(x.cosine, 6), x.n) for x in sums.collect()}
    near = np.where(cos >= floor, cos, 0)
    want = {(7 * i, g + d): (round(near[i, grp == g].sum(), 6), int((cos[i, grp == g] >= floor).sum())) for i in range(230) for g in range(7) for d in (0, 10) if (cos[i, grp == g] >= floor).any()}
    assert got == want
    counts = {x.cosine: x.n for x in S.cosine_counts(df).collect()}
    value, n = np.unique(cos[np.triu_indices(230, 1)], return_counts=True)
    assert counts == dict(zip(value.tolist(), n.tolist(), strict=True))


@pytest.mark.parametrize("floor", [0.3, 0.9, 0.97])
def test_linking_pairs_join_what_all_pairs_join(vectors, floor):
    df, cos, _ = vectors
    edges = S.linking(df, floor)
    whole, few = ({tuple(x) for x in connected_components(e).collect()} for e in (S.cosines(df, df, floor, below=True).toDF("src", "dst", "cosine"), edges))
    assert whole == few and (cos >= floor).sum() / 2 >= edges.count() > 0
    if floor == 0.3:
        assert edges.count() < (cos >= floor).sum() / 2 / 3


def test_reordered_sets_shuffle_no_pairs(spark, monkeypatch):
    for name, n in (("ASKED", 6), ("HELD", 11), ("SENT", 2)):
        monkeypatch.setattr(R, name, n)
    r = random.Random(8)
    given, queries = r.sample(range(300), 70), [*range(0, 300, 15), 301]
    ranked = {q: r.sample([g for g in given if g != q], r.randrange(12)) for q in queries}
    long = lambda x: cut(spark.createDataFrame([(k,) for k in x], "id long").repartition(3))
    rows = spark.createDataFrame([(q, k, 3 * i) for q, x in ranked.items() for i, k in enumerate(x)], "query_id long, id long, rank int")
    got = R.reordered(long(queries), long(given), rows)
    assert not dealt(got)
    assert set(given) & set(queries)
    want = {(q, k, i) for q in queries for i, k in enumerate(ranked[q] + sorted(set(given) - {q} - set(ranked[q])))}
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_evidence_needs_the_nearest_of_each_alone(spark):
    rows = [(1, 2, 0.9, "b"), (2, 1, 0.9, "a"), (3, 2, 0.8, "b"), (2, 3, 0.8, "c"), (3, 1, 0.7, "a"), (1, 3, 0.7, "c"), (8, 9, 0.9, "x"), (9, 8, 0.9, "y")]
    hits = spark.createDataFrame(rows, "src long, dst long, cosine double, snippet string")
    near = spark.createDataFrame([(1, 0.2)], "node long, cosine double")
    nearest = hits.where("cosine = 0.9 or src = 2")
    joined = spark.createDataFrame([(1, 2), (3, 2), (8, 9)], "src long, dst long")
    assert votes.theme_evidence(hits, near, 0.5).collect() == votes.theme_evidence(nearest, near, 0.5, joined=joined).collect() != []


@pytest.mark.parametrize("sent", [64_000_000, 0])
def test_many_queries_find_what_one_search_finds(spark, monkeypatch, sent):
    from corpusloom.operators import lexical as L

    for name, n in (("ASKED", 7), ("DOCS", 9), ("PLACES", 60), ("HITS", 50), ("SENT", sent)):
        monkeypatch.setattr(L, name, n)
    r = random.Random(6)
    text = lambda n: " ".join("w" * r.choice([1, 1, 2, 3, 4, 5, 9]) + r.choice("abc") for _ in range(n))
    docs = spark.createDataFrame([(k, text(r.randrange(4)), text(r.randrange(80))) for k in range(160)] + [(500, None, ""), (501, "", None)], "doc_id long, title string, text string").repartition(3)
    terms = spark.createDataFrame([(-q, w) for q in range(40) for w in text(r.randrange(1, 6)).split()] + [(90, "nowhere"), (91, "wwa"), (91, "nowhere")], "query_id long, term string")
    fields = {"title": 2.5, "text": 1.0}
    want = {tuple(x) for x in L.search(docs, fields, terms, 6).collect()}
    found = L.search_many(docs, fields, terms, 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange") == 1  # the best of each query alone
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(want) > 150 and set(got) == want


def test_blocks_hold_whole_numbers_exactly():
    import pyarrow as pa

    for row, kind in (([0.0, 255.0], np.uint8), ([0.5, -1.0], np.float32), ([0.1, 256.0], np.float64), ([float("nan"), 1.0], np.float64)):
        ids, m = S._held()(pa.table({"id": pa.array([5]), "v": pa.array([row], pa.list_(pa.float64()))}))
        assert m.dtype == kind and m[0].tolist()[1] == row[1]
    with pytest.raises(ValueError, match="vectors of 1 and 2 numbers"):
        S._held()(pa.table({"id": pa.array([5, 6]), "v": pa.array([[1.0], [1.0, 2.0]])}))
