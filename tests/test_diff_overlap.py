"""Line diffs against a whole table; overlap and containment joins against nested loops."""

import random
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import diff as D
from corpusloom.operators import overlap as O
from corpusloom.operators import spread


def table_diff(a, b):
    """The plain table, cell by cell."""
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and t[i + 1][j] >= t[i][j + 1]):
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("add", b[j]))
            j += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30), st.sampled_from([1, 6, 40]))
def test_parted_table_gives_the_same_operations(a, b, whole):
    before, D.WHOLE = D.WHOLE, whole
    try:
        got = D.difference("\n".join(a), "\n".join(b))
    finally:
        D.WHOLE = before
    assert got == table_diff(a, b)


def test_long_texts_take_linear_memory():
    r = random.Random(1)
    a = [f"line {r.randrange(400)}" for _ in range(2500)]
    b = [x for x in a if r.random() < 0.9]
    b[100:100] = [f"new {k}" for k in range(300)]
    tracemalloc.start()
    got = D.difference("\n".join(a), "\n".join(b))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8_000_000  # the table would have 6 million cells
    assert [x for k, x in got if k != "add"] == a and [x for k, x in got if k != "del"] == b
    assert got == table_diff(a, b)
    assert [k for k, _ in D.difference("x\n" * 3000, "y")] == ["del"] * 3001 + ["add"]
    assert len(D.difference("x\n" * 3000, "x\n" * 2999, None)) == 3001


def test_folding():
    same = lambda *x: [("same", k) for k in x]
    ops = [*same(*"abcdef"), ("del", "x"), *same(*"ghijkl"), ("add", "y"), *same(*"mnopq")]
    assert D.folded(ops) == [("skip", None, 4), ("same", "e", 1), ("same", "f", 1), ("del", "x", 1), ("same", "g", 1), ("same", "h", 1), ("skip", None, 2), ("same", "k", 1), ("same", "l", 1), ("add", "y", 1), ("same", "m", 1), ("same", "n", 1), ("skip", None, 3)]
    assert D.folded([*same("a"), ("add", "b")]) == [("same", "a", 1), ("add", "b", 1)] and D.folded([]) == [] and D.folded(same(*"abc")) == [("skip", None, 3)]
    # a run that is one longer than what stays is shown whole
    assert D.folded([("add", "x"), *same(*"abcde"), ("add", "y")]) == [("add", "x", 1), *(("same", k, 1) for k in "abcde"), ("add", "y", 1)]


def test_line_diffs_of_rows(spark):
    rows = [(1, "a\nb\nc", "a\nc\nd"), (2, None, "x\ny"), (3, "x", None), (4, "", ""), (5, "q", "q"), (1, "a\nb\nc", "a\nc\nd")]
    got = D.line_diffs(spark.createDataFrame(rows, "n long, old string, new string"), "n", "old", "new", fold=False).orderBy("n", "place").collect()
    assert [(r.type, r.text) for r in got if r.n == 1][::2] == [("same", "a"), ("del", "b"), ("same", "c"), ("add", "d")]
    assert {(r.n, r.type, r.text) for r in got if r.n > 1} == {(2, "add", "x"), (2, "add", "y"), (3, "del", "x"), (5, "same", "q")}


def test_query_diffs_equal_the_table(spark):
    from corpusloom.plans import corpus_queries as Q

    sf = "/root/testdata/sf0.001"
    pairs = {r.doc_id: (r.before, r.after) for r in Q._edited(spark, sf).collect()}
    want = {}
    for k, (a, b) in pairs.items():
        n = {t: 0 for t in ("same", "add", "del")}
        for t, _ in table_diff(D.lines(a), D.lines(b)):
            n[t] += 1
        want[k] = n
    got = {r.doc_id: {"same": r.same, "add": r.added, "del": r.gone} for r in Q.set_line_diff(spark, sf).collect()}
    assert got == {k: n for k, n in want.items() if any(n.values())} and any(n["add"] and n["del"] and n["same"] for n in want.values())


def test_sharing(spark, monkeypatch):
    monkeypatch.setattr(spread, "HOT", 16)
    r = random.Random(3)
    rows = [(k, [r.choice(["a", "b", "c", None]), *(str(r.randrange(200)) for _ in range(r.randrange(4)))]) for k in range(150)] + [(200, None), (201, []), (202, [None]), (3, ["z"])]
    df = spark.createDataFrame(rows, "id long, items array<string>")
    sets = {}
    for k, x in rows:
        sets.setdefault(k, set()).update(i for i in x or [] if i is not None)
    got = {(x.left_id, x.right_id): x.shared for x in O.sharing(df, df, "items").collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if sets[a] & sets[b]}
    one = spark.createDataFrame([(k, x) for k, x in rows if k != 3], "id long, items array<string>")
    members, pairs = O.sharing_classes(one, "items")
    of = {x.id: x.class_id for x in members.collect()}
    assert all(sets[k] == sets[c] and c == min(j for j in sets if j != 3 and sets[j] == sets[k]) for k, c in of.items())
    heads = sorted(set(of.values()))
    assert {(x.left_id, x.right_id) for x in pairs.collect()} == {(a, b) for a in heads for b in heads if a < b and sets[a] & sets[b]}


def test_names_inside(spark, monkeypatch):
    monkeypatch.setattr(spread, "HOT", 16)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abü") for _ in range(r.randrange(1, 5)))
    rows = [(k, r.randrange(3), r.choice(["The ", ""]) + "-".join(word() for _ in range(r.randrange(0, 4)))) for k in range(400)] + [(500, 1, None), (501, 1, "grand hotel aurora"), (502, 1, "Hotel Aurora"), (503, 2, "hotel aurora!")]
    got = {(x.grp, x.name_a, x.name_b): (x.n_a, x.n_b, x.first_a, x.first_b) for x in O.names_inside(spark.createDataFrame(rows, "id long, grp int, title string"), ["grp"], "title").collect()}
    names = {}
    for k, g, t in rows:
        plain = "".join(c for c in (t or "").lower() if c.isalnum())
        if plain:
            names.setdefault((g, plain), []).append(k)
    want = {}
    for (g, a), x in names.items():
        for (h, b), y in names.items():
            if g == h and (len(x) > 1 if a == b else len(a) >= 5 and a in b):
                want[g, a, b] = (len(x), len(y), min(x), min(y))
    assert got == want and (1, "hotelaurora", "grandhotelaurora") in got and len(got) > 50


def test_counterpart_keys(spark):
    said = ["Anna <anna@firm.example.com>", "anna@FIRM.example.com", "bob@gmail.com", "eve@gmail.com", "+44 20 7946 0958", "020 7946 0958", "4420794609@s.whatsapp.net", "info@other.example.com", "hello"]
    df = spark.createDataFrame(list(enumerate(said)), "id int, who string")
    df = df.select("id", O.counterpart_keys(df.who).alias("keys"))
    got = {(x.left_id, x.right_id) for x in O.sharing(df, df, "keys").where("left_id < right_id").collect()}
    assert got == {(0, 1), (0, 7), (1, 7), (4, 5)}
    assert np.array(df.where("id = 8").first()["keys"]).tolist() == ["at:hello"]
