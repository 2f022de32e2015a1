"""The ledger against a plain version over one sorted list."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ledger as L
from corpusloom.sources import shards
from corpusloom.streaming import feeds

DAY = dt.datetime(2024, 1, 1)


def event(seq, op, key, path="r", plan=None, before=None, after=None, thread=None, minute=None, reason="why"):
    return path, key, DAY + dt.timedelta(minutes=seq if minute is None else minute), seq, op, plan, before, after, thread, "c", reason


def plain(events, kept=L.KEPT):
    """``(path, key): status, reason, undo, undone`` and ``path: content, human_edited, not_threads`` and outcomes, all in one loop."""
    entries, content, edited, wrong, outcomes, texts = {}, {}, {}, {}, {}, {}
    done = {}  # per path the keys that can be taken back
    for path, key, at, seq, op, plan, before, after, thread, _, reason in sorted((e for e in events if e[0]), key=lambda e: (e[2], e[3], e[4], e[1] or "")):
        now, mine = content.get(path), entries.get((path, key))
        content.setdefault(path, None)

        def put(status, why, undo=False, undone=None, pair=None, path=path, key=key, at=at):
            entries[path, key] = [status, why, undo, undone]
            if pair:
                texts[path, key] = pair
            if undo:
                done.setdefault(path, []).append(key)
                for k in done[path][:-kept]:
                    entries[path, k][2] = False
                done[path] = done[path][-kept:]

        if op == "edit":
            content[path], edited[path], out = after, True, "edited"
        elif not key:
            out = "rejected"
        elif op == "submit":
            if mine:
                out = "duplicate"
            elif plan == "apply" and now != before:
                out = "rejected"
            elif plan == "apply":
                content[path], out = after, "applied"
                put("applied", reason, True, pair=(before, after))
            else:
                out = "review" if plan == "review" else "rejected"
                put(out, reason, pair=(before, after, thread))
        elif op == "undo":
            ok = mine and mine[0] == "applied" and mine[2] and mine[3] is None and now == texts[path, key][1]
            out = "applied" if ok else "rejected"
            if ok:
                content[path] = texts[path, key][0]
                mine[2], mine[3] = False, at
                done[path].remove(key)
        elif not mine or mine[0] != "review":
            out = "rejected"
        elif op == "dismiss" or (op == "sweep" and plan == "dismiss"):
            thread = texts[path, key][2]
            if thread and thread not in wrong.setdefault(path, []):
                wrong[path].append(thread)
            put("dismissed", "dismissed by you")
            out = "dismissed"
        elif op == "sweep":
            content[path], out = texts[path, key][1], "applied"
            put("applied", "approved by you")
        elif op == "recheck" and plan != "apply":
            out = "review"
        else:
            pair = (before, after) if before is not None or after is not None else texts[path, key][:2]
            if now != pair[0]:
                out = "review" if op == "recheck" else "rejected"
            else:
                content[path], out = pair[1], "applied"
                put("applied", "approved by you" if op == "approve" else f"{mine[1]} (held earlier; released on re-check)", op == "approve", pair=pair)
        outcomes[path, seq] = out
    return {k: tuple(v) for k, v in entries.items()}, {p: (c, edited.get(p, False), wrong.get(p, [])) for p, c in content.items()}, outcomes


def some(n, seed, paths=6):
    r = random.Random(seed)
    out = []
    for k in range(n):
        path = f"r{r.randrange(paths)}"
        op = r.choice(["submit"] * 5 + ["approve", "approve", "dismiss", "undo", "undo", "recheck", "sweep", "edit"])
        plan = r.choice(["apply", "apply", "review", "review", "reject"]) if op != "sweep" else r.choice(["approve", "dismiss"])
        value = lambda: r.choice([None, "x", "y", "z"])
        pair = (value(), value()) if op in ("submit", "edit") or r.random() < 0.2 else (None, None)
        out.append((path, r.choice([None, *(f"{path}k{r.randrange(25)}" for _ in range(30))]), DAY + dt.timedelta(minutes=r.randrange(n)), k, op, plan, *pair, r.choice([None, "t1", "t2"]), "c", f"why {k}"))
    return out


def content(entries, records):
    return {(e.path, e.key): (e.status, e.reason, e.undo, e.undone) for e in entries.collect()}, {r.path: (r.content, r.human_edited, r.not_threads) for r in records.collect()}


@pytest.mark.parametrize("kept", [50, 2])
def test_fold_equals_plain_version(spark, kept):
    rows = some(900, kept)
    df = spark.createDataFrame(rows, L.EVENTS)
    folded = L.fold(df.repartition(5), kept=kept).cache()
    entries, records, outcomes = plain(rows, kept)
    assert content(L.entries_of(folded), L.records_of(folded)) == (entries, records)
    assert {(o.path, o.seq): o.outcome for o in L.outcomes_of(folded).collect()} == outcomes
    assert set(outcomes.values()) == {"applied", "rejected", "review", "dismissed", "duplicate", "edited"} and any(e[3] for e in entries.values())
    assert L.fold(df.where("false")).collect() == []


def test_named_cases(spark):
    rows = [
        event(0, "submit", "a", plan="apply", after="1"), event(1, "submit", "b", plan="apply", before="1", after="2"),
        event(2, "undo", "a"),  # changed since
        event(3, "undo", "b"), event(4, "undo", "b"), event(5, "undo", "a"), event(6, "undo", "z"),
        event(7, "submit", "a", plan="apply", after="9"), event(8, "submit", "c", plan="apply", before="not so", after="9"), event(9, "submit", "c", plan="apply", after="3"),
        event(10, "submit", "d", plan="review", before="3", after="4", thread="t"), event(11, "dismiss", "d"), event(12, "approve", "d"),
        event(13, "submit", "e", plan="review", before="3", after="5"), event(14, "recheck", "e", plan="review"), event(15, "recheck", "e", plan="apply"), event(16, "undo", "e"),
        event(17, "edit", None, after=None), event(18, "undo", "c"),
    ]
    folded = L.fold(spark.createDataFrame(rows, L.EVENTS))
    got = [(o.outcome, o.reason) for o in L.outcomes_of(folded).orderBy("seq").collect()]
    assert got == [
        ("applied", "why"), ("applied", "why"), ("rejected", "changed since"), ("applied", "taken back by you"), ("rejected", "already taken back"), ("applied", "taken back by you"), ("rejected", "no such change"),
        ("duplicate", "applied"), ("rejected", "conflict"), ("applied", "why"), ("review", "why"), ("dismissed", "dismissed by you"), ("rejected", "no such pending review"),
        ("review", "why"), ("review", "why"), ("applied", "why (held earlier; released on re-check)"), ("rejected", "too old to take back"), ("edited", None), ("rejected", "no longer there"),
    ]
    assert [(r.content, r.human_edited, r.not_threads) for r in L.records_of(folded).collect()] == [(None, True, ["t"])]
    entries = L.entries_of(folded)
    assert [r.key for r in L.recent(entries, 3).collect()] == ["e", "c", "b"]
    assert [r.status for r in L.status(entries, spark.createDataFrame([("d",), ("q",)], "key string")).orderBy("key").collect()] == ["dismissed", None]
    left = {r.key: (r.undo, r.after) for r in L.pruned(entries, 0).collect()}
    assert left["c"] == (False, None) and {r.key: r.undo for r in entries.collect()}["c"]


@pytest.mark.parametrize("batches", [1, 3, 8])
@pytest.mark.parametrize("shuffled", [False, True])
def test_any_number_of_batches_gives_the_same_states(spark, tmp_path, batches, shuffled):
    rows, home = some(300, 7), str(tmp_path / "l")
    rows.sort(key=lambda e: (e[2], e[3]))
    if shuffled:
        random.Random(batches).shuffle(rows)
    size = -(-len(rows) // batches)
    for k in range(batches):
        L.apply(spark, home, spark.createDataFrame(rows[k * size : (k + 1) * size], L.EVENTS), k, parts=4, kept=3)
    assert content(L.entries(spark, home), L.records(spark, home)) == plain(rows, 3)[:2]
    number = shards.current(spark, home).number
    L.apply(spark, home, spark.createDataFrame(rows[:9], L.EVENTS), batches - 1)
    assert shards.current(spark, home).number == number


def test_ledger_of_a_stream(spark, tmp_path, monkeypatch):
    rows, home = some(150, 11), str(tmp_path / "l")
    spark.createDataFrame(rows, L.EVENTS).repartition(4, "seq").write.parquet(f"{tmp_path}/ledger.parquet")
    real, failed = shards.commit, []

    def once(*a):
        if len(failed) < 1 and a[2].number == 1:
            failed.append(1)
            raise KeyError("killed")
        return real(*a)

    monkeypatch.setattr(shards, "commit", once)
    with pytest.raises(Exception, match="killed"):
        L.follow(feeds.stream(spark, str(tmp_path), "ledger", 1), home, parts=4)
    L.follow(feeds.stream(spark, str(tmp_path), "ledger", 1), home, parts=4)
    assert failed and content(L.entries(spark, home), L.records(spark, home)) == plain(rows)[:2]


def test_fold_query_equals_plain_version(spark):
    from corpusloom.plans import corpus_queries as Q

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in Q._ledger_events(spark, sf).select(*[x.split()[0] for x in L.EVENTS.split(", ")]).collect()]
    entries = plain(rows)[0]
    got = {(r.path, r.key): (r.status, r.reason, r.undo) for r in Q.rec_ledger_fold(spark, sf).collect()}
    assert got == {k: v[:3] for k, v in entries.items()}
    assert {v[0] for v in got.values()} == {"applied", "review", "rejected", "dismissed"}
    assert Q._ledger_events(spark, sf).where(F.col("path").isNull()).count() == 0
