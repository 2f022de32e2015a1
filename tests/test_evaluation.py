"""Link prediction against plain ranks, and verdicts against a plain replay."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as V
from corpusloom.streaming import feeds, verdicts


@pytest.mark.parametrize("quiet", [False, True])
def test_link_ranks_equal_plain_ranks(spark, monkeypatch, quiet):
    monkeypatch.setattr(V, "BLOCK", 40)
    r = np.random.default_rng(int(quiet))
    note = r.integers(0, 60, 260)
    v = r.normal(size=(260, 6))
    v[10:30] = v[10]  # ties
    chunks = spark.createDataFrame([(int(n), [float(x) for x in row], bool(n % 7)) for n, row in zip(note, v, strict=True)] + [(None, [1.0] * 6, True), (5, None, True)], "note long, v array<double>, open boolean").repartition(3)
    links = [(int(a), int(b)) for a, b in r.integers(0, 64, (150, 2))]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(u @ u.T, 6)
    score = lambda a, b: cos[np.ix_(note == a, note == b)].max()
    there = set(note.tolist())
    may = {n for n in there if not quiet or n % 7}
    want = {}
    for a, b in set(links):
        if a != b and a in there and b in may:
            want[a, b] = 1 + sum(score(a, n) > score(a, b) for n in may - {a, b})
    ranks = V.link_ranks(chunks, spark.createDataFrame([*links, links[0]], "src long, dst long"), F.col("open") if quiet else None).cache()
    assert {(x.src, x.dst): x["rank"] for x in ranks.collect()} == want and len(want) > 80
    by = {}
    for (a, _), k in want.items():
        by.setdefault(a, []).append(k)
    s = V.link_summary(ranks).first()
    plain = (len(by), len(want), np.mean([np.mean([k <= 5 for k in x]) for x in by.values()]), np.mean([np.mean([k <= 10 for k in x]) for x in by.values()]), np.mean([1 / min(x) for x in by.values()]), np.mean([1 / k for k in want.values()]))
    assert tuple(s) == pytest.approx(plain)


def judged(pair, words):
    return ("restates", "contradicts", "neither")[(len(pair) + len(words)) % 3]


def plain_replay(rows):
    out, kept, calls = {}, {}, {}
    for session, pair, seq, words, chars in sorted(rows, key=lambda x: (x[2], x[1])):
        mine = kept.setdefault(session, {})
        w = set(words)
        if chars < 80:
            out[session, seq] = ("silent", None)
        elif pair in mine and len(mine[pair][0] & w) / max(1, len(mine[pair][0] | w)) >= 0.6:
            out[session, seq] = ("reused", mine[pair][1])
        elif calls.get(session, 0) >= 60:
            out[session, seq] = ("silent", None)
        else:
            calls[session] = calls.get(session, 0) + 1
            mine[pair] = (w, judged(pair, words))
            if len(mine) > 5:
                mine.pop(next(iter(mine)))
            out[session, seq] = ("called", judged(pair, words))
    return out, calls


def test_verdicts_are_reused_in_a_replay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(verdicts, "KEPT", 5)
    r = random.Random(3)
    rows, text = [], {}
    for seq in range(900):
        session, pair = f"s{r.randrange(3)}", f"p{r.randrange(8)}"
        words = text.get((session, pair)) or [r.choice("abcdefghijkl") for _ in range(6)]
        words = [w if r.random() < 0.85 else r.choice("mnopqrst") for w in words]
        text[session, pair] = words
        rows.append((session, pair, seq, sorted(set(words)), r.choice([40, 200, 300, 400])))
    want, calls = plain_replay(rows)
    s = verdicts.Session()
    assert [s.ask(p, w, c, judged) for n, p, _, w, c in rows if n == "s1"] == [want[n, q] for n, _, q, _, _ in rows if n == "s1"] and max(calls.values()) == 60
    for k in range(3):  # files in order of time
        df = spark.createDataFrame(rows[k * 300 : k * 300 + 300], "session string, pair string, seq long, words array<string>, chars int")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/asked.parquet")
    monkeypatch.undo()
    want, calls = plain_replay_of(rows)
    feed = feeds.stream(spark, str(tmp_path), "asked", 1)
    q = verdicts.verdicts(feed, judged).writeStream.format("memory").queryName("said").option("checkpointLocation", f"{tmp_path}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(x.session, x.seq): (x.action, x.verdict) for x in spark.table("said").collect()}
    assert got == want and {a for a, _ in want.values()} == {"called", "reused", "silent"}


def plain_replay_of(rows):
    """With all pairs kept, as there are fewer than the bound."""
    out, kept, calls = {}, {}, {}
    for session, pair, seq, words, chars in rows:
        had = kept.get((session, pair))
        if chars < 80:
            out[session, seq] = ("silent", None)
        elif had and len(had[0] & set(words)) / len(had[0] | set(words)) >= 0.6:
            out[session, seq] = ("reused", had[1])
        elif calls.get(session, 0) >= 60:
            out[session, seq] = ("silent", None)
        else:
            calls[session] = calls.get(session, 0) + 1
            kept[session, pair] = (set(words), judged(pair, words))
            out[session, seq] = ("called", judged(pair, words))
    return out, calls
