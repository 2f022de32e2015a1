"""Source mixing against SQL and a plain version."""

import re
from collections import defaultdict

from corpusloom.llm import mixing

from .oracle import frames

SCHEMA = "doc_id long, text string, source string, size string, _copies int"


def plain(rows):
    sizes = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    by = defaultdict(int)
    for d, _, s, *_ in rows:
        by[s] += sizes[d]
    order = sorted(by, key=lambda s: (s is None, (s or "").encode("utf8")))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    held = set()
    while True:
        left = 1.5 * sum(by.values()) - sum(2 * by[s] for s in held)
        free = sum(w[s] for s in order if s not in held)
        over = {s for s in order if s not in held and w[s] * left / free > 2 * by[s]}
        if not over:
            break
        held |= over
    return sizes, by, {s: 2.0 * by[s] if s in held else w[s] * left / free for s in order}


def test_targets(spark):
    rows = [(i, "w " * (i % 7 * 5) + "\tx\n", s, "q", 1) for i, s in enumerate(["b", "a", None, "é", "Z", "b", "b", "c"] * 40)]
    sizes, by, goal = plain(rows)
    got = mixing.mix_report(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        s = rows[r.doc_id][2]
        assert (r["size"], r.source_size) == (sizes[r.doc_id], by[s]) and abs(r.target - goal[s]) < 1e-6
        assert r.taken in (0, r["size"], 2 * r["size"])


def test_mix_keeps_columns_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "q", 1), (1, "a b c", "s", "q", 1), (None, "a b", None, None, None), (3, None, "s", None, 2), (4, "", "t", None, 2)], SCHEMA)
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {1, None}
    total = sum(r.taken for r in mixing.mix_report(docs).collect())
    assert total == sum(len((r.text or "").split()) for r in out.collect())
    assert mixing.mix(docs.where("false")).collect() == [] and mixing.mix_report(docs.where("false")).collect() == []


def test_odd_separators(spark):
    texts = ["", " ", "a", " a\x0bb\x0c", "a b c", "\r\n", "x  y\tz "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", mixing.words(df.t).alias("n")).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in enumerate(texts)}


def test_sql_twin(spark):
    a, b = frames(spark, "op2_source_mixing", "/root/testdata/sf0.01")
    assert a == b
