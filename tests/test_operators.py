"""Operators on small inputs with known outcomes."""

import random

from pyspark.sql import functions as F

from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.operators import chunks as C
from corpusloom.operators import graph, lexical
from corpusloom.operators import ranking as R
from corpusloom.sources.lineage import cut, tallied


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_is_exact(spark):
    r = random.Random(1)
    words = {"".join(r.choice("abü") for _ in range(r.randrange(1, 14))) for _ in range(400)}
    asked = sorted(words)[::9]
    got = lexical.fuzzy(spark.createDataFrame([(w,) for w in words], "term string"), spark.createDataFrame([(1, w) for w in asked], "query_id int, term string")).collect()
    want = {(q, w) for q in asked for w in words if distance(q, w) <= len(q) // 5}
    assert {(x.asked, x.term) for x in got} == want and len(got) == len(want)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {x: find(x) for x in root}
    low = {}
    for x, y in want.items():
        low[y] = min(low.get(y, x), x)
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: low[y] for x, y in want.items()}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_components_by_one_task_or_many(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(30)] + [(200 + k, 150 + k % 7) for k in range(30)]
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 131)} | {x: 150 + (x - 200) % 7 for x in range(200, 230)} | {k: k for k in range(150, 157)}
    sc, jobs = spark.sparkContext, []
    df = cut(spark.createDataFrame(edges, "src long, dst long"))
    for task, few in ((1000, 1000), (20, 1000), (20, 10)):
        monkeypatch.setattr(graph, "_TASK_EDGES", task)
        monkeypatch.setattr(graph, "_FEW_NODES", few)
        sc.setJobGroup(f"components {task} {few}", "")
        assert {x.node: x.component for x in graph.connected_components(df).collect()} == want
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"components {task} {few}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    # a job for each round, besides those of the edges and of the result
    assert 0 < jobs[0] < 20, jobs


def test_totals_are_those_of_the_rows(spark):
    df, (n, total) = tallied(spark.range(1000).repartition(7).where("id % 3 = 0"), F.count(F.lit(1)), F.sum("id"))
    assert (n, total) == (334, sum(range(0, 1000, 3))) == tuple(df.agg(F.count("*"), F.sum("id")).first())
    assert tallied(spark.range(0).distinct(), F.count(F.lit(1)), F.sum("id"))[1] == (0, None)


def test_chunks():
    assert [h for _, h, _ in C.chunk("# A\nx\n\n# B\ny", "t")] == ["A", "B"]
    assert len(C.chunk("a\n\nb\n\nc", "t")) == 1
    long = "word " * 300
    assert all(len(t) <= 400 for *_, t in C.chunk(long, "t", 400))
    assert C.chunk("```\n# no\n```\nx", "t")[0][1:] == (None, "```\n# no\n```\nx")
    assert C.chunk("# only\n## two", "t") == [(0, "only", "t\nonly\ntwo")] and C.chunk("", "t") == [(0, None, "t")] and C.chunk("", "") == []
    assert C.headings_of("---\na: b\n---\n# A #\n```\n# no\n```\n## B") == ["A", "B"]
    assert "quote" in C.chunk("---\na quote\n---\nx", "t")[0][2] and "key" not in C.chunk("---\nkey: v\n---\nx", "t")[0][2]
    assert len(C.chunk("\n".join(["| a | b |"] * 140), "t")) == 1
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(i)) for i in range(60))
    assert "".join("".join(t for *_, t in C.chunk(text, "t")).split()) == "".join(text.split())


def test_hard_split():
    assert C.hard_split("aa bb cc", 5) == ["aa bb", "cc"] and C.hard_split("abcdefgh", 3) == ["abc", "def", "gh"]
    assert C.hard_split("  ", 3) == [] and C.hard_split("ab  cd ", 3) == ["ab", "cd"] and C.hard_split("aaaa b", 3) == ["aaa", "a b"]
    r = random.Random(9)
    for _ in range(300):
        text = "".join(r.choice("ab  c") for _ in range(r.randrange(60)))
        got, rest = C.hard_split(text, 7), text.strip()
        for g in got:
            assert 0 < len(g) <= 7 and rest.startswith(g)
            rest = rest[len(g) :].strip()
        assert rest == ""


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_text_functions(spark):
    s = F.lit
    assert one(spark, T.times_in(s("at 9:30am and 17:05, then 7pm; noon")))[0] == ["09:30", "12:00", "17:05", "19:00"]
    assert one(spark, T.amounts_in(s("£1,020 and 40 EUR, or 10.50 + 4")))[0] == [4.0, 10.5, 14.5, 40.0, 1020.0]
    assert one(spark, T.fnv1a(s("")), T.fnv1a(s("a")), T.fnv1a(s("foobar"))) == (2166136261, 3826002220, 3214735720)
    assert one(spark, T.wikilinks(s("[[a/B|c]] [[D#e]]")))[0] == ["B", "D"]
    assert one(spark, T.repoint_links(s("[[Old|x]] [[Older]]"), "Old", "New"))[0] == "[[New|x]] [[Older]]"
    assert one(spark, T.title_from_content(s("---\nk: v\n---\n\n# My *title*\nx")))[0] == "My title"
    assert one(spark, P.day_key(s("d/March 5, 2024.md")), P.day_key(s("2024-03-05.md")), P.day_key(s("x"))) == ("03-05", "03-05", None)
    assert one(spark, *(P.looks_periodic(s(x)) for x in ("2024-W05", "2024-Q3", "May 1, 2024", "notes")))[:] == (True, True, True, False)
    assert one(spark, P.personal_flags(s("My boss says I'm afraid")))[0] == ["mentions people close to you", "first-person emotional content"]
    assert one(spark, P.incompleteness(s("# A\n\n# B\n- [ ] x"), s(2)))[0] == 6


def test_ranking_functions(spark):
    s = F.lit
    assert [round(one(spark, R.calibrated(s(x)))[0], 3) for x in (0.666, 0.741, 0.9, 0.995)] == [0.688, 0.761, 0.92, 1.0]
    assert abs(one(spark, R.raw_of(R.calibrated(s(0.62))))[0] - 0.62) < 1e-9
    assert one(spark, R.confidence(s(0), s(None).cast("double")), R.confidence(s(1), s(None).cast("double"))) == (1.0, 0.5)
    assert one(spark, R.prominence(s(0.1)), R.prominence(s(0.45)), R.prominence(s(0.9))) == ("faint", "quiet", "prominent")
    assert one(spark, R.recency_signal(s(30)), R.atomicity_signal(s(12))) == (0.5, 0.25)
    lists = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (0, "c", 2), (1, "b", 0), (1, "a", 1), (1, "d", 2)], "list_id int, id string, rank int")
    fused = {x.id: x.fused for x in R.rrf(lists).collect()}
    assert set(fused) == set("abcd") and min(fused["a"], fused["b"]) > max(fused["c"], fused["d"])


def test_hash_vectors_equal_hash_embedding(spark):
    from corpusloom.operators import similarity as S

    docs = spark.createDataFrame([(1, "Hello, hello wörld 42"), (2, None), (3, "é"), (4, "a"), (5, "b a"), (6, "zz" * 500)], "doc_id long, text string").coalesce(1)
    a = {r.id: list(r.v) for r in S.dense(S.hash_embedding(docs)).collect()}
    b = {r.id: list(r.v) for r in S.hash_vectors(docs).collect()}
    assert a == b and set(a) == {1, 4, 5, 6}


def test_note_functions(spark):
    from corpusloom.functions import notes as N

    s = F.lit
    q = N.parse_query('alpha Type:"my kind" in:Folder since:2024-01-01 "a phrase" beta')
    assert q == {"text": "alpha beta", "phrases": ["a phrase"], "type": "my kind", "folder": "Folder", "since": "2024-01-01"}
    assert N.parse_list("a/\nb, a") == ["a", "b"]
    assert [r.heading for r in one(spark, N.segments(s("intro\n## A\nx\n## B\ny")))[0]] == ["A", "B"]
    assert [r.text for r in one(spark, N.segments(s("just\ntext")))[0]] == ["just\ntext"]
    assert one(spark, N.questions(s("## Questions to elaborate\n- one?\n- two?\n## Next\n- no")))[0] == ["one?", "two?"]
    assert one(spark, N.inert_quote(s("[[x]] `c` #tag %%")))[0] == "[ [x] ] 'c' # tag % %"
    m = lambda **k: F.create_map(*[s(x) for kv in k.items() for x in kv])
    assert one(spark, N.merged_frontmatter(m(a="1", t="[x, y]"), m(a="2", t="[y, z]", b="3")))[0] == {"a": "1", "t": "[x, y, z]", "b": "3"}
    assert one(spark, N.embed_text(s("n.md"), s("Title"), s("x")), N.embed_text(s("2024-01-02.md"), s("2024-01-02"), s("x"))) == ("Title\n\nx", "x")
    assert one(spark, N.with_backlink(s("body\n\n## Related\n- [[A]]"), "B"))[0] == "body\n\n## Related\n- [[B]]\n- [[A]]"
    assert one(spark, N.is_empty_note(s("---\ncreated: 1\n---\n")), N.is_empty_note(s("---\nmood: x\n---\n")), N.is_empty_note(s("x"))) == (True, False, False)
    assert one(spark, N.triage(s("# "), s(0.99)), N.triage(s("w " * 40), s(0.95)), N.triage(s("w " * 40), s(None).cast("double"))) == ("archive", "merge", "elaborate")
    assert one(spark, N.legacy_kind(s("Flight")), N.legacy_kind(s("stay")), N.legacy_kind(s("tour"))) == ("transport", "stay", "activity")
    none, some = F.array().cast("array<string>"), F.array(s("x"))
    assert one(spark, N.publish_review(s(True), s(False), some, s(0.0), none), N.publish_review(s(True), s(False), none, s(0.1), none)) == ("hold", "cleared")
    assert one(spark, N.validate(s("stay"), s("create"), s("k"), s("t")), N.validate(s("x"), s("create"), s(""), s(""))) == ([], ["no key", "unknown kind", "no title"])
    found = spark.createDataFrame([("a.md", "A", 0.8, False, False), ("b.md", "B", 0.9, True, False)], "path string, title string, cosine double, linked boolean, dismissed boolean")
    assert [r.title for r in N.ghost(found, "text", "see ", "", 0.7).collect()] == ["A"] and N.ghost(found, "text", "[[x", "", 0.7).collect() == []
    n = spark.createDataFrame([("f/My Note.md", ["#proj/x"]), ("g/Other.md", ["y"])], "path string, tags array<string>")
    assert [r.path for r in N.filtered(n, tag="proj", words="note my").collect()] == ["f/My Note.md"]
