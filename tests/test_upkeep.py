"""The sharded store and the index that follows a feed, against plain dictionaries."""

import datetime as dt
import os
import random

import pytest

from corpusloom.sources import shards, snapshot
from corpusloom.streaming import feeds, upkeep

DAY = dt.datetime(2024, 1, 1)
CHANGES = "path string, old_path string, op string, at timestamp, seq long, text string"


def words(note):
    """A note's words; some notes can't be read."""
    if note["text"] and note["text"].startswith("bad"):
        raise ValueError("unreadable")
    return [(w, k) for k, w in enumerate((note["text"] or "").split())]


WORDS = "word string, place int"


def changes(n, seed, bad=False):
    r = random.Random(seed)
    out = []
    for k in range(n):
        op = r.choice(["modify", "modify", "create", "delete", "rename"])
        path, old = f"n{r.randrange(40)}", f"n{r.randrange(40)}"
        text = ("bad " if bad and r.random() < 0.15 else "") + " ".join(r.choice("abcdef") for _ in range(r.randrange(4)))
        out.append((path, old if op == "rename" else None, op, DAY + dt.timedelta(minutes=r.randrange(n)), k, text))
    return out


def plain(rows):
    """``path: text`` by the last change of each path."""
    last = {}
    for path, old, op, at, seq, text in rows:
        put = [(path, None if op == "delete" else text)] + ([(old, None)] if op == "rename" else [])
        for p, t in put:
            if p not in last or (at, seq, t is not None) > last[p][:3]:
                last[p] = (at, seq, t is not None, t)
    return {p: x[3] for p, x in last.items() if x[2]}


def content(spark, home):
    notes = {r.path: r.text for r in upkeep.notes(spark, home).collect()}
    units = {}
    for r in upkeep.units(spark, home).collect():
        units.setdefault(r.path, []).append((r.place, r.word))
    assert units == {p: [(k, w) for k, w in enumerate(t.split())] for p, t in notes.items() if t} or {p: sorted(u) for p, u in units.items()} == {p: list(enumerate(t.split())) for p, t in notes.items() if t.split()}
    return notes


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_any_number_of_batches_gives_the_same_index(spark, tmp_path, batches):
    rows, home = changes(200, 1), str(tmp_path / "i")
    random.Random(batches).shuffle(rows)  # changes may come late
    for k in range(batches):
        upkeep.apply(spark, home, spark.createDataFrame(rows[k::batches], CHANGES), k, words, WORDS, parts=8)
    assert content(spark, home) == plain(rows)
    # a batch that comes again changes nothing
    before = shards.numbers(spark, home)
    upkeep.apply(spark, home, spark.createDataFrame(rows[:50], CHANGES), batches - 1, words, WORDS)
    assert shards.numbers(spark, home) == before


def test_feed_of_files(spark, tmp_path):
    rows, home = changes(120, 3), str(tmp_path / "i")
    spark.createDataFrame(rows, CHANGES).repartition(6, "seq").write.parquet(f"{tmp_path}/changes.parquet")
    upkeep.follow(feeds.stream(spark, str(tmp_path), "changes", 2), home, words, WORDS, parts=8)
    assert content(spark, home) == plain(rows)
    assert len(shards.numbers(spark, home)) == 2  # older ones are swept


def test_bytes_written_follow_the_batch(spark, tmp_path):
    home = str(tmp_path / "i")
    rows = [(f"n{k}", None, "create", DAY, k, "text " * 50) for k in range(3000)]
    first = upkeep.apply(spark, home, spark.createDataFrame(rows, CHANGES), 0, words, WORDS, parts=64)

    def size(state, name, since=None):
        runs = {run for p, (run, _) in state.tables[name][1].items()} - ({run for _, (run, _) in since.tables[name][1].items()} if since else set())
        return sum(os.path.getsize(os.path.join(d, f)) for run in runs for d, _, fs in os.walk(f"{home}/{name}/run={run}") for f in fs)

    small = upkeep.apply(spark, home, spark.createDataFrame([("n7", None, "modify", DAY + dt.timedelta(1), 1, "new")], CHANGES), 1, words, WORDS)
    for name in ("notes", "units"):
        assert size(small, name, first) < size(first, name) / 20
        changed = [p for p, x in small.tables[name][1].items() if first.tables[name][1].get(p) != x]
        assert len(changed) == 1


def test_crash_leaves_the_old_state_and_repeats_cleanly(spark, tmp_path, monkeypatch):
    rows, home = changes(150, 5), str(tmp_path / "i")
    upkeep.apply(spark, home, spark.createDataFrame(rows[:80], CHANGES), 0, words, WORDS, parts=8)
    real = shards.commit
    for where in ("written", "commit"):
        monkeypatch.setattr(shards, where, lambda *_: (_ for _ in ()).throw(KeyError("killed")))
        with pytest.raises(KeyError):
            upkeep.apply(spark, home, spark.createDataFrame(rows[80:], CHANGES), 1, words, WORDS)
        monkeypatch.undo()
        assert content(spark, home) == plain(rows[:80])
    assert shards.commit is real
    upkeep.apply(spark, home, spark.createDataFrame(rows[80:], CHANGES), 1, words, WORDS)
    assert content(spark, home) == plain(rows)
    assert shards.sweep(spark, home, 1) > 0 and content(spark, home) == plain(rows)
    with pytest.raises(RuntimeError):  # a second writer
        shards.commit(spark, home, shards.current(spark, home))


def test_a_failing_note_is_tried_three_times_and_parked(spark, tmp_path):
    home, at = str(tmp_path / "i"), lambda k: DAY + dt.timedelta(hours=k)
    send = lambda number, *rows: upkeep.apply(spark, home, spark.createDataFrame(rows, CHANGES), number, words, WORDS, parts=4)
    tries = lambda: {r.path: r.tries for r in shards.read(spark, home, shards.current(spark, home), "failures").collect()}
    send(0, ("a", None, "create", at(0), 0, "one"), ("b", None, "create", at(0), 1, "two"))
    send(1, ("a", None, "modify", at(1), 2, "bad"), ("b", None, "modify", at(1), 3, "three"), ("c", None, "create", at(1), 4, "bad c"))
    assert content(spark, home) == {"a": "one", "b": "three"} and tries() == {"a": 1, "c": 1}
    send(2, ("d", None, "create", at(2), 5, "four"), ("c", None, "modify", at(2), 6, "good c"))
    assert content(spark, home) == {"a": "one", "b": "three", "c": "good c", "d": "four"} and tries() == {"a": 2}
    send(3, ("a", None, "modify", at(0), 1, "late"))  # older than what fails
    assert tries() == {"a": 3} and [(r.path, r.error) for r in upkeep.parked(spark, home).collect()] == [("a", "ValueError: unreadable")]
    send(4, ("d", None, "delete", at(4), 7, None))
    assert tries() == {"a": 3}  # parked: not tried again
    send(5, ("a", None, "modify", at(5), 8, "bad again"))
    assert tries() == {"a": 4} and content(spark, home)["a"] == "one"
    send(6, ("a", None, "modify", at(6), 9, "mended"))
    assert tries() == {} and content(spark, home) == {"a": "mended", "b": "three", "c": "good c"}
    upkeep.forget(spark, home, "2025-01-01")
    assert content(spark, home) == {"a": "mended", "b": "three", "c": "good c"} and shards.read(spark, home, shards.current(spark, home), "notes").count() == 3


def test_feed_with_failures_ends(spark, tmp_path):
    rows, home = changes(100, 9, bad=True), str(tmp_path / "i")
    spark.createDataFrame(rows, CHANGES).repartition(3, "seq").write.parquet(f"{tmp_path}/changes.parquet")
    upkeep.follow(feeds.stream(spark, str(tmp_path), "changes", 1), home, words, WORDS, parts=4)
    last = plain(rows)
    got = content(spark, home)
    assert {r.path for r in upkeep.parked(spark, home).collect()} == {p for p, t in last.items() if t.startswith("bad")}
    assert all(got[p] == t for p, t in last.items() if not t.startswith("bad"))


def test_snapshot_killed_while_saving_stays_readable(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "s")
    old = spark.createDataFrame([(f"{k}.md", "x" * 150_000, k) for k in range(120)], "path string, text string, n int")
    snapshot.save({"notes": old}, home, "r")
    assert shards.current(spark, home).parts == snapshot.shards_for(old) > snapshot.LEAST
    new = old.selectExpr("path", "text", "n + 1000 as n")
    dirty = spark.createDataFrame([("5.md",)], "path string")
    for where in ("written", "commit"):
        monkeypatch.setattr(shards, where, lambda *_: (_ for _ in ()).throw(KeyError("killed")))
        for d in (dirty, None):
            with pytest.raises(KeyError):
                snapshot.save({"notes": new}, home, "r", d)
        monkeypatch.undo()
        assert sorted(r.n for r in snapshot.load(spark, home, "r")["notes"].collect()) == list(range(120))
    for _ in range(3):
        snapshot.save({"notes": new}, home, "r", dirty)
    runs = {f for f in os.listdir(f"{home}/notes") if f.startswith("run=")}
    used = {run for n in shards.numbers(spark, home) for run, _ in shards.current(spark, home, n).tables["notes"][1].values()}
    assert runs == {f"run={x}" for x in used} and len(shards.numbers(spark, home)) == 2
    got = {r.path: r.n for r in snapshot.load(spark, home, "r")["notes"].collect()}
    assert got["5.md"] == 1005 and sum(n < 1000 for n in got.values()) > 80
