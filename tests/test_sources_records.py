"""Vaults, snapshots, records, change sets and votes on small inputs."""

import os

from corpusloom.operators import changes as X
from corpusloom.operators import records as E
from corpusloom.operators import votes as A
from corpusloom.sources import snapshot, vault


def test_vault(spark, tmp_path):
    files = {"a/One.md": "---\ntags: [x, y]\nalias: Uno\n---\nsee [[Two]] and [[b/Two|2]] and [[Nowhere#h]]", "b/Two.md": "no frontmatter [[One]] [[Two]]", ".obs/skip.md": "x", "private/p.md": "x", "c.txt": "x"}
    for name, text in files.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    notes = vault.scan_vault(spark, str(tmp_path), ["private"])
    got = {r.path: r for r in notes.collect()}
    assert set(got) == {"a/One.md", "b/Two.md"} and got["a/One.md"].fm["alias"] == "Uno" and got["a/One.md"].link_count == 3 and got["a/One.md"].folder == "a"
    meta = {r.path: r.m for r in notes.select("path", vault.searchable_meta(notes.fm).alias("m")).collect()}
    assert meta["a/One.md"] == "Uno x y" and meta["b/Two.md"] == ""
    links = {(r.src, r.dst): (r.n, r.resolved) for r in vault.resolve_links(notes).groupBy("src", "dst", "resolved").sum("n").toDF("src", "dst", "resolved", "n").collect()}
    assert links == {("a/One.md", "b/Two.md"): (2, True), ("a/One.md", "Nowhere"): (1, False), ("b/Two.md", "a/One.md"): (1, True)}


def test_snapshot(spark, tmp_path):
    home = str(tmp_path / "s")
    notes = spark.createDataFrame([("a.md", 1), ("b.md", 2)], "path string, n int")
    assert snapshot.load(spark, home, "r1") is None
    snapshot.save({"notes": notes}, home, "r1")
    assert sorted(r.n for r in snapshot.load(spark, home, "r1")["notes"].collect()) == [1, 2]
    assert snapshot.load(spark, home, "r2") is None
    newer = spark.createDataFrame([("a.md", 5), ("b.md", 9)], "path string, n int")
    snapshot.save({"notes": newer}, home, "r1", dirty=spark.createDataFrame([("a.md",)], "path string"))
    assert {r.path: r.n for r in snapshot.load(spark, home, "r1")["notes"].collect()} == {"a.md": 5, "b.md": 2}


def test_vault_root_is_no_pattern_and_block_lists_are_read(spark, tmp_path):
    root = tmp_path / "my (old) vault+1 [x]"
    os.makedirs(root / "f g")
    (root / "f g" / "N.md").write_text("---\ntags:\n  - one\n  - two words\naliases: [A, B]\nempty:\ntitle: 'T: x'\n---\nbody\n- item")
    r = vault.scan_vault(spark, str(root)).first()
    assert r.path == "f g/N.md" and r.fm == {"tags": "[one, two words]", "aliases": "[A, B]", "empty": "", "title": "T: x"}


def test_snapshot_drops_what_is_deleted(spark, tmp_path):
    home = str(tmp_path / "s")
    notes = spark.createDataFrame([(f"{k}.md", k) for k in range(30)], "path string, n int")
    empty = notes.where("false")
    snapshot.save({"notes": notes, "none": empty}, home, "r1")
    assert snapshot.load(spark, home, "r1")["none"].count() == 0
    fewer = notes.where("n not in (3, 7)")
    snapshot.save({"notes": fewer, "none": empty}, home, "r1", dirty=spark.createDataFrame([("3.md",), ("7.md",)], "path string"))
    assert sorted(r.n for r in snapshot.load(spark, home, "r1")["notes"].collect()) == [k for k in range(30) if k not in (3, 7)]
    assert snapshot.load(spark, home, "r1")["notes"].columns == ["path", "n"]
    assert snapshot.shards_for(spark.createDataFrame([(f"{k}.md", "x" * 100_000) for k in range(200)], "path string, text string")) > 4


def test_assessments(spark):
    stays = spark.createDataFrame([
        ("Hotel Aurora", "2026-05-01", "2026-05-04", "Aurora", "2026-05-02", "2026-05-03"),
        ("Hotel Aurora", "2026-05-01", "2026-05-04", "Grand Palace", "2026-05-02", "2026-05-03"),
        ("Hotel Aurora", "2026-05-01", "2026-05-04", "Aurora", "2026-05-04", "2026-05-06"),
        ("Hotel Aurora", "2026-05-01", "2026-05-04", "", "2026-05-02", None),
    ], "title string, start string, end string, q_name string, q_date string, q_end string")
    assert [(r.positives, r.excluded, r.conflict) for r in E.assess_stay(stays).collect()] == [(2, False, False), (0, False, True), (0, True, False), (0, False, False)]
    legs = spark.createDataFrame([("2026-05-01T09:00", "BA 12", "LHR", "TXL", "2026-05-01", "ba12", None, None), ("2026-05-01T09:00", "BA 12", "London", "Berlin", "2026-05-01T09:10", None, "London", "Berlin"), ("2026-05-01T09:00", "BA 12", "London", "Berlin", "2026-05-01", None, None, None), ("2026-05-01T09:00", "BA 12", "London", "Berlin", "2026-05-02", "BA12", None, None)], "start string, number string, origin string, target string, q_date string, q_number string, q_from string, q_to string")
    assert [(r.positives, r.excluded) for r in E.assess_transport(legs).collect()] == [(2, False), (2, False), (0, False), (0, True)]
    bills = spark.createDataFrame([("Power Co", "2026-04", 40.0, "power co", "2026-04", 40.001), ("Power Co", "2026-04", 40.0, "power co", "2026-05", 40.0)], "payee string, period string, amount double, q_payee string, q_period string, q_amount double")
    assert [(r.positives, r.excluded) for r in E.assess_bill(bills).collect()] == [(3, False), (2, True)]
    acts = spark.createDataFrame([("Boat tour", "2026-05-01T10:00", "Pier", "boat tour", "2026-05-01T11:00", None), ("Boat tour", "2026-05-01T10:00", "Pier 4", "other", "2026-05-01T10:20", "pier 4"), ("Boat tour", "2026-05-01T10:00", "Pier", "boat tour", "2026-05-02", None)], "title string, start string, place string, q_name string, q_date string, q_place string")
    assert [(r.positives, r.excluded) for r in E.assess_activity(acts).collect()] == [(1, False), (1, False), (0, True)]
    src = E.compare_with_source(spark.createDataFrame([(1, "boat  Tour", "2026-05-01T10:00", 40.0), (2, "gone", "2026-05-01", 1.0)], "id int, quote string, start string, price double"), spark.createDataFrame([(1, "Boat tour at 11:00, £40"), (2, "else")], "id int, line string"))
    assert {r.id: (r.gone, r.times_differ, r.amounts_differ) for r in src.collect()} == {1: (False, True, False), 2: (True, False, False)}


def test_audits_and_values(spark):
    r = spark.createDataFrame([(1, "stay", "booked", "2026-01-05", "2026-01-03"), (2, "stay", "done", "2026-01-01", "2026-01-02"), (3, "trip", "planned", None, None), (4, "bill", "issued", "2026-01-01", None)], "id int, kind string, state string, start string, end string")
    assert [x.id for x in E.reversed_dates(r).collect()] == [1] and [x.id for x in E.undated(r).collect()] == [3]
    assert sorted(x.id for x in E.still_open(r, "2026-11-18").collect()) == [1, 4]
    v = spark.range(1).select(E.clean_number(lit("1,020.5")), E.clean_date(lit("2026-01-02T10:30:00Z")), E.clean_date(lit("2026-13-02")), E.norm_ref(lit("ab-1 2")), E.norm_phone(lit("+44 20 7946 0958"))).first()
    assert tuple(v) == (1020.5, "2026-01-02T10:30", None, "AB12", "079460958")
    p = spark.createDataFrame([(1, ["bad"], "unique", False, True), (2, [], "several", False, True), (3, [], "unique", False, True), (4, [], "none", False, False)], "id int, errors array<string>, answer string, human_edited boolean, state_ok boolean")
    assert [x.decision for x in E.plan(p).orderBy("id").collect()] == ["reject", "review", "apply", "reject"]


def lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def vote(spark, *rows):
    df = spark.createDataFrame([("e", f, float(w)) for f, w in rows], "entry string, folder string, weight double")
    return [r.folder for r in A.placement(df).collect()]


def test_placement(spark):
    assert vote(spark, ("a/b", 1), ("a/b", 1), ("c", 1)) == ["a/b"]
    assert vote(spark, ("a/b", 1), ("a/c", 1), ("d", 1)) == ["a"]
    assert vote(spark, ("a", 1), ("b", 1)) == [] and vote(spark, ("a", 1)) == [] and vote(spark, ("", 1), ("", 1)) == []
    assert vote(spark, ("a", 3), ("b", 1)) == ["a"]


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, body string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, body string")
    cs = X.change_set(old, new, "path", "body")
    assert {r.path: r.type for r in cs.collect()} == {"b": "modify", "c": "delete", "d": "create"}
    assert X.conflicts(cs, old, "path", "body").collect() == []
    assert [r.path for r in X.conflicts(cs, new, "path", "body").orderBy("path").collect()] == ["b", "c", "d"]
    assert X.conflicts(X.inverse(cs), new, "path", "body").collect() == []
    moves = spark.createDataFrame([("1", "x/a.png"), ("2", "x/a.png"), ("3", "y/b")], "src string, target string")
    got = {r.src: r.target for r in X.unique_names(moves, spark.createDataFrame([("x/a.png",)], "target string")).collect()}
    assert got == {"1": "x/a 2.png", "2": "x/a 3.png", "3": "y/b"}
    moves = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "a 2"), ("4", "a 2"), ("5", "a"), ("6", "a"), ("7", "b.md")], "src string, target string")
    got = {r.src: r.target for r in X.unique_names(moves, spark.createDataFrame([("a 4",), ("b.md",), ("b 2.md",), ("b 3.md",)], "target string")).collect()}
    assert got == {"1": "a", "2": "a 3", "3": "a 2", "4": "a 2 2", "5": "a 5", "6": "a 6", "7": "b 4.md"}
