"""Lexical search with prefixes and edits against plain loops."""

import math
import random
import re

from corpusloom.operators import lexical as L

from .test_operators import distance


def plain(docs, asked, k, share, boosts=None):
    """``query, id, score``: all terms met, each exactly, as a prefix or within edits, by counting."""
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in docs.items()}
    words = {i: w for i, w in words.items() if w}
    mean = sum(map(len, words.values())) / len(words)
    vocabulary = {w for x in words.values() for w in x}
    df = {w: sum(w in x for x in words.values()) for w in vocabulary}
    out = []
    for q, terms in asked.items():
        stands = {(a, w) for a in terms for w in vocabulary if w == a or w.startswith(a) or (share is not None and distance(a, w) <= math.floor(len(a) * share))}
        scores = []
        for i, x in words.items():
            if {a for a, w in stands if w in x} == set(terms):
                score = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * 2.2 / (x.count(w) + 1.2 * (0.25 + 0.75 * len(x) / mean)) for _, w in stands if w in x)
                scores.append((-round(score, 6), i))
        out += [(q, i, -s) for s, i in sorted(scores)[:k]]
    return sorted(out)


def run(spark, docs, asked, k, share):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string")
    index = L.postings(df, {"text": 1.0})
    return sorted((r.query_id, r.id, r.score) for r in L.bm25(index, L.expanded(index, terms, share), k, every=True).collect())


def test_and_with_a_term_met_nowhere(spark):
    docs = {1: "alpha beta", 2: "alpha gamma", 3: "zebra alpha", 4: ""}
    asked = {1: ["alpha", "zeta"], 2: ["alpha", "zeb"], 3: ["nothing"], 4: ["alph", "gam"]}
    for share in (None, 0.2):
        assert [(q, i) for q, i, _ in run(spark, docs, asked, 9, share)] == [(2, 3), (4, 2)]


def test_expanded_and_is_exact(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.choice([2, 3, 6, 7, 8, 11])))
    vocabulary = [word() for _ in range(80)]
    vocabulary += [w + r.choice("abc") for w in vocabulary] + [w[:2] + r.choice("abc") + w[3:] for w in vocabulary]
    docs = {i: " ".join(r.choice(vocabulary) for _ in range(r.randrange(30))) for i in range(150)}
    asked = {q: sorted({r.choice(vocabulary) for _ in range(r.choice([1, 2, 2, 3]))}) for q in range(40)}
    found = {}
    for share in (None, 0.15, 0.2):
        found[share] = run(spark, docs, asked, 5, share)
        want = plain(docs, asked, 5, share)
        assert [x[:2] for x in found[share]] == [x[:2] for x in want] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(found[share], want, strict=True))
    assert len({len(x) for x in found.values()}) > 1 and found[None]


def test_gateway_query_equals_plain_search(spark, tmp_path):
    from corpusloom.plans import search_queries as Q

    r = random.Random(2)
    vocabulary = [f"{a}{b}{c}er" for a in ("trans", "inter", "sub", "over") for b in ("marin", "nation", "script") for c in ("al", "es", "x")]
    docs = {i: " ".join(r.choice(vocabulary) for _ in range(90)) for i in range(60)}
    sealed = {3, 7, 11}
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in sealed)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = {q: [r.choice(vocabulary)[: r.choice([9, 11, 30])], r.choice(vocabulary)] for q in range(12)}
    items[12] = ["nowhere", vocabulary[0]]
    spark.createDataFrame([(q, " ".join(t)) for q, t in items.items()], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(x.query_id, x.id): x.score for x in Q.lex_gateway(spark, str(tmp_path)).collect()}
    # titles count three times, so a text with three copies of its title has the same counts
    open_docs = {i: " ".join([t[:60]] * 3 + [t]) for i, t in docs.items() if i not in sealed}
    want = {(q, i): s for q, i, s in plain(open_docs, {q: sorted(set(t)) for q, t in items.items()}, 25, 0.15)}
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def plain_fields(units, asked, k, share, boosts):
    """``query, id, score, by field`` with counts, lengths and means of each field by itself."""
    words = {f: {i: re.findall(r"[^\W_]+", (u[f] or "").lower()) for i, u in units.items()} for f in boosts}
    words = {f: {i: w for i, w in x.items() if w} for f, x in words.items()}
    vocabulary = {w for x in words.values() for t in x.values() for w in t}
    out = []
    for q, terms in asked.items():
        weight = {}
        for a in terms:
            weight[a, a] = 1.0
            for w in vocabulary - {a}:
                if w.startswith(a):
                    weight[a, w] = 0.375 * len(a) / (len(a) + 0.3 * (len(w) - len(a)))
                if share is not None and (d := distance(a, w)) <= math.floor(len(a) * share):
                    weight[a, w] = max(weight.get((a, w), 0), 0.45 * len(a) / (len(a) + d))
        rows = []
        for i in units:
            fields, met = {}, set()
            for f, boost in boosts.items():
                mean = sum(map(len, words[f].values())) / max(1, len(words[f]))
                for (a, w), by in weight.items():
                    tf = words[f].get(i, []).count(w)
                    if tf:
                        df = sum(w in x for x in words[f].values())
                        met.add(a)
                        fields[f] = fields.get(f, 0) + by * boost * math.log(1 + (len(words[f]) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[f][i]) / mean))
            if met == set(terms):
                rows.append((-round(sum(fields.values()), 6), i, {f: round(s, 6) for f, s in fields.items()}))
        out += [(q, i, -s, f) for s, i, f in sorted(rows, key=lambda x: x[:2])[:k]]
    return sorted(out, key=lambda x: x[:2])


def test_fields_are_scored_by_themselves(spark):
    from corpusloom.operators import fielded as D

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.choice([2, 3, 6, 7, 8])))
    vocabulary = [word() for _ in range(40)]
    vocabulary += [w + r.choice("abc") for w in vocabulary] + [w[:2] + r.choice("abc") + w[3:] for w in vocabulary]
    some = lambda n: r.choice([None, "", " ".join(r.choice(vocabulary) for _ in range(r.randrange(n)))])
    units = {i: {"title": some(4), "meta": some(3), "heading": some(3), "text": " ".join(r.choice(vocabulary) for _ in range(r.randrange(25)))} for i in range(120)}
    asked = {q: sorted({r.choice(vocabulary)[: r.choice([4, 9])] for _ in range(r.choice([1, 2, 3]))}) for q in range(30)} | {30: [vocabulary[0], "nowhere"]}
    df = spark.createDataFrame([(i, *u.values()) for i, u in units.items()], "id long, title string, meta string, heading string, text string").repartition(3)
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string")
    for share in (None, 0.2):
        weighted = D.weighted(D.vocabulary(df, list(D.BOOSTS)), terms, share)
        got = sorted(((x.query_id, x.id, x.score, x.by_field) for x in D.search(df, weighted, 7).collect()), key=lambda x: x[:2])
        want = plain_fields(units, asked, 7, share, D.BOOSTS)
        assert [x[:2] for x in got] == [x[:2] for x in want] and len(want) > 40
        for a, b in zip(got, want, strict=True):
            assert abs(a[2] - b[2]) < 2e-6 and a[3].keys() == b[3].keys() and all(abs(a[3][f] - b[3][f]) < 2e-6 for f in b[3])


def test_search_lines_are_parsed_alike(spark):
    from corpusloom.functions import notes as N

    lines = ["", "plain words", 'type:note in:"My Folder" since:2024-01 rest "a phrase" more', 'TYPE:"x y" type:z "one" "two three"', "in: nothing", '"open', "pretype:no mytype:x", 'in:"type:q w" e', "since:2024 since:2025"]
    got = spark.createDataFrame([(x,) for x in lines], "raw string").select("raw", N.parsed_query(__import__("pyspark").sql.functions.col("raw")).alias("q")).collect()
    assert {x.raw: x.q.asDict() for x in got} == {x: N.parse_query(x) for x in lines}
