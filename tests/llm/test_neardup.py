"""Near-duplicates against brute force."""

import os
import random
import re

from corpusloom.llm import neardup
from corpusloom.sources.lineage import cut

SCHEMA = "doc_id long, text string, lang string, n long, value string"


def brute(rows, percent):
    sets = {}
    for d, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def make(seed, groups=6, size=60):
    r = random.Random(seed)
    word = lambda: r.choice("ab cd ef gh Ij kl mn op qr st uv wx yz".split()) + str(r.randrange(900))
    rows, header = [], [word() for _ in range(40)]
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(6, 200))]
        for _ in range(r.choice((1, 3, size))):
            t = list(base)
            for _ in range(r.randrange(0, 1 + len(t) // 12)):
                t[r.randrange(len(t))] = word()
            rows.append(" ".join(t))
    rows += [" ".join(header + [word() for _ in range(r.randrange(5, 60))]) for _ in range(50)]
    rows += [None, "", " \n\t ", "one", "One", "two words", "two  words", "a b c d e", "É é", "é É"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = make(seed)
        df = spark.createDataFrame([(d, t, None, d, "x") for d, t in rows], SCHEMA).repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 85).collect()}
        assert got == brute(rows, 85)


def test_long_lists_without_hubs(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHORT", 2)
    rows = make(5, 3, 30)
    df = spark.createDataFrame([(d, t, None, d, "x") for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 80).collect()}
    assert got == brute(rows, 80)


def test_edges(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "x y z", "a", 1, "v"), (1, "x y z", "a", 1, "v"), (None, "x y z", None, None, None), (2, None, "b", 2, "v"), (3, "q " * 3000, "b", 2, "v")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id, r.n_shingles, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, None, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 2, 0, True), (3, 3, 1, True)]
    kept = neardup.near_dedup(spark.createDataFrame([(1, "a b c d e f", "x", 1, "v"), (2, "A b c d e f", "x", 1, "v")], SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "n", "value"] and [r.doc_id for r in kept.collect()] == [1]


def test_one_id_with_two_texts_and_two_ids_with_one(spark):
    a, b, c = ("".join(f"{x}{k} " for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + "more"), (3, b + "more"), (5, a), (5, c), (6, b), (6, b), (7, c + "more")]
    df = spark.createDataFrame([(d, t, None, d, "x") for d, t in rows], SCHEMA).repartition(4)
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df, 85).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (5, 5), (6, 1), (6, 1), (7, 5)]
    kept = sorted((r.doc_id, r.text[:1]) for r in neardup.near_dedup(df, 85).collect())
    assert kept == [(1, "a"), (1, "b"), (5, "c")]


def test_hot_texts_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "SHORT", 4)
    rows = make(7, 4, 40)
    df = spark.createDataFrame([(d, t, None, d, "x") for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 85).collect()}
    assert got == brute(rows, 85)


def test_small_tables_leave_few_files(spark, monkeypatch):
    """Files of tables of a few rows don't grow with the shuffle partitions, whose number is the cluster's."""
    monkeypatch.setattr(neardup, "SHORT", 4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:59], f"x{i}"]) if i < 20 else f"other text number {i} {i * i} of its own", "x", 1, "v") for i in range(60)]
    neardup.cut(spark.range(1))
    folder = re.sub("^file:/*", "/", spark.sparkContext._jsc.sc().getCheckpointDir().get())
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}

    def files():
        return {f"{d}/{f}" for d, _, names in os.walk(folder) for f in names if f.startswith("part-")}

    before = files()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 85).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {i: 0 if i < 20 else i for i in range(60)}
    print("files", made := len(files() - before))
    assert made < 400


def test_small_tables_need_few_jobs(spark, monkeypatch):
    """Each stage and each table that travels to all tasks takes megabytes of the driver."""
    monkeypatch.setattr(neardup, "SHORT", 2)
    rows = make(3)
    df = cut(spark.createDataFrame([(d, t, None, d, "x") for d, t in rows], SCHEMA))
    sc = spark.sparkContext
    sc.setJobGroup("few jobs", "")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 85).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("few jobs"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == brute(rows, 85) and 0 < jobs < 170, jobs
