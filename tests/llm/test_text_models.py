"""Tokens against the tiktoken library; toxicity and language against brute force and held-out texts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, langid, toxicity

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, score double"
HARD = ["", "a", " ", "\n\n \t x", "it's I'll  we've   done", "naïve café ñandú größe 日本語 😀😀", "a" * 3000, " " * 3000 + "x", "1234567 89", "x\r\n\r\ny", "\x1c\x85   b"]


def random_texts(n):
    r = random.Random(3)
    bits = ["the", " cat", "  ", "\n", "'s", "123", "é", "日本", "!?", "'ll", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "\t", " \n", "😀"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(10, 300))) for _ in range(n)]


@pytest.mark.parametrize("size, overlap, whole, run", [(64, 16, 1 << 16, 128), (64, 16, 0, 2), (64, 16, 200, 3)])
def test_bpe_equals_library(spark, monkeypatch, size, overlap, whole, run):
    for name, value in (("CHUNK", size), ("OVERLAP", overlap), ("WHOLE", whole), ("RUN", run)):
        monkeypatch.setattr(bpe, name, value)
    texts = HARD + random_texts(40)
    rows = [(i, t, None, 0.0) for i, t in enumerate(texts)] + [(None, None, None, None), (0, HARD[0], None, None), (15, texts[15], None, None)]
    got = bpe.tokenize(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, P.PATTERN, True).collect()
    enc = bpe.encoding(PATH, P.PATTERN)
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else ""
        ids = enc.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids), text
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.tokenize(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).collect() == []


def test_bpe_of_long_texts_at_their_real_chunks(spark):
    r = random.Random(8)
    bits = ["the", " cat", "  ", "\n", "'s", " 123", "é", " 日本", "!?", "'ll", "\t", " \n", "😀", " naïve", "   \r\n"]
    texts = ["".join(r.choice(bits) for _ in range(n)) for n in (3000, 20_000, 60_000, 500_000)] + ["x" * 90_000, "word " * 20_000 + "y" * 9000 + " word" * 9000, " " * 70_000 + "z"]
    rows = [(i, t, None, 0.0) for i, t in enumerate([*texts, *texts])]
    got = bpe.tokenize(spark.createDataFrame(rows, SCHEMA).repartition(4), PATH, P.PATTERN).collect()
    enc = bpe.encoding(PATH, P.PATTERN)
    want = [hashlib.sha256(",".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest() for t in texts]
    assert sorted((x.doc_id, x.ids_sha256) for x in got) == [(i, want[i % len(texts)]) for i in range(len(rows))]
    chunks = [bpe.edges(texts[3][a : a + bpe.CHUNK + bpe.OVERLAP], a, P.PATTERN, bpe.OVERLAP) for a in range(0, len(texts[3]) - bpe.OVERLAP, bpe.CHUNK)]
    assert len(chunks) > 100 and len(bpe.parted(chunks)) == len(chunks) - 1


def test_language_edges_and_accuracy(spark):
    r = random.Random(1)
    vocab = {"en": "the of and to in is that house river".split(), "fr": "le la les des une dans être où".split()}
    rows = [(i, " ".join(r.choice(vocab[x]) for _ in range(30)), x, 1.0) for i in range(200) for x in (r.choice(("en", "fr")),)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs.where("doc_id < 100"))
    got = langid.predict(docs, model, F.col("doc_id"), F.col("lang")).collect()
    assert all(x.lang == x.lang_pred and 0 <= x.score <= 1 for x in got if x.doc_id >= 100)
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "en", 1.0), (3, "12 34 |", None, 1.0), (4, "Ê", None, 1.0), (4, "Ê", None, 1.0)], SCHEMA)
    assert [x.lang_pred for x in langid.predict(odd, model, F.col("doc_id")).orderBy("doc_id").collect()] == ["und", "und", "und", "fr", "fr"]
    nothing = langid.train(docs.where("false"))
    assert {x.lang_pred for x in langid.predict(odd, nothing, F.col("doc_id")).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model, F.col("doc_id")).collect() == []


def test_grams_do_not_depend_on_parts(monkeypatch):
    raw = langid.characters(np.frombuffer(("Ein schöner Tag. " * 50).encode(), np.uint8))
    whole = np.sort(np.concatenate(list(langid._grams(raw))))
    monkeypatch.setattr(langid, "_PART", 37)
    assert (np.sort(np.concatenate(list(langid._grams(raw)))) == whole).all()


def test_language_characters_are_code_points():
    chars = lambda t: "".join(map(chr, langid.characters(np.frombuffer(t.encode(), np.uint8)).tolist()))
    assert chars("  Ein SCHÖNER—Tag, 12 ") == "ein schöner tag "
    assert chars("ЖУК") == "жук" and chars("日本語。") == "日本語 " and chars("हिन्दी") == "हिन्दी"
    assert chars("12 . ́") == "" and chars("A-b") == "a b"
    grams = np.concatenate(list(langid._grams(langid.characters(np.frombuffer("日本語".encode(), np.uint8)))))
    assert len(grams) == 3 + 2 + 1  # of whole characters


def plain_language(train, text, most=4):
    """Naive Bayes over the n-grams of a text by plain counts: the likeliest language and its share."""
    def grams(t):
        c = langid.characters(np.frombuffer((t or "").encode(), np.uint8))
        return np.concatenate(list(langid._grams(c))).tolist() if len(c) else []

    n, docs = {}, {}
    for t, lang in train:
        docs[lang] = docs.get(lang, 0) + 1
        for g in grams(t):
            n.setdefault(lang, {})[g] = n.setdefault(lang, {}).get(g, 0) + 1
    logs = {}
    for lang, c in n.items():
        total = sum(c.values()) + langid.SMOOTH * langid.BUCKETS
        logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((c.get(g, 0) + langid.SMOOTH) / total) for g in grams(text))
    top = max(logs.values())
    return min(k for k, v in logs.items() if v > top - 1e-9), 1 / sum(math.exp(v - top) for v in logs.values())


def test_language_by_plain_counts_and_many_languages(spark, monkeypatch):
    r = random.Random(4)
    vocab = {f"l{k:02d}": ["".join(r.choice("абвгдеabcdeßñ日本") for _ in range(4)) for _ in range(12)] for k in range(23)}
    rows = [(i, " ".join(r.choice(vocab[x]) for _ in range(12)), x, 1.0) for i in range(300) for x in (r.choice(sorted(vocab)),)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    train = docs.where("doc_id < 250")
    long = " ".join(vocab["l07"]) * 30_000
    asked = docs.where("doc_id >= 250").unionByName(spark.createDataFrame([(900, None, None, 1.0), (901, "12", None, 1.0), (902, long, None, 1.0)], SCHEMA))
    one = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(asked, langid.train(train), F.col("doc_id")).collect()}
    monkeypatch.setattr(langid, "SHARD", 5)
    model = langid.train(train)
    assert len(model) == 5
    many = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(asked, model, F.col("doc_id")).collect()}
    assert many.keys() == one.keys() and len(one) == 53
    for k, (lang, score) in one.items():
        assert many[k][0] == lang and many[k][1] == pytest.approx(score, abs=1e-6)
        if 250 <= k < 300:
            want = plain_language([x[1:3] for x in rows[:250]], rows[k][1])
            assert lang == want[0] and score == pytest.approx(want[1], abs=1e-3)
    assert one[900] == one[901] == ("und", 0.0) and one[902][0] == "l07"


def test_toxicity_nearest_are_exact(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    r = np.random.default_rng(5)
    rows = [(np.flatnonzero(m), r.random(int(m.sum())) + 0.1) for m in r.random((60, 30)) < 0.15]
    index = toxicity.Index(np.arange(30, dtype=np.uint64), np.ones(30), rows, np.arange(60) % 2, np.ones(60), np.arange(60))
    dense = {}
    for k, (at, w) in enumerate(rows):
        v = np.zeros(30)
        v[at] = w / np.sqrt((w * w).sum()) if len(at) else 0
        dense[k] = v
    for at, w in rows[:20]:
        if not len(at):
            continue
        q = np.zeros(30)
        q[at] = w / np.sqrt((w * w).sum())
        best = sorted((float(q @ v) for v in dense.values()), reverse=True)[:5]
        got = index.nearest(at, q[at], 5)[1]
        assert np.allclose(got, best[: len(got)], atol=1e-5) and all(x <= 1e-5 for x in best[len(got) :])


def test_toxicity_learns(spark):
    r = random.Random(2)
    words = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        t = [r.choice(words) for _ in range(40)]
        if toxic:
            for _ in range(3):
                t[r.randrange(40)] = r.choice(["Vilebad,", "nastyword", "vilebadly"])
        rows.append((i, " ".join(t), "x", 0.0))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    index = toxicity.train(docs, spark.createDataFrame([*labels, (5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int"))
    got = toxicity.score(docs, index, F.col("doc_id")).collect()
    assert all(x.predicted == (x.doc_id % 4 == 0) for x in got if x.doc_id >= 300)
    odd = spark.createDataFrame([(1, None, None, None), (2, "", None, 1.0), (2, "", None, 1.0), (3, "zzz", None, 1.0)], SCHEMA)
    got = toxicity.score(odd, index, F.col("doc_id")).collect()
    assert len(got) == 4 and all(0 <= x.score < 0.5 and x.evidence == [] for x in got)
    none = toxicity.train(docs.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(0 <= x.score <= 1 for x in toxicity.score(odd, none, F.col("doc_id")).collect())
    assert toxicity.score(docs.where("false"), index, F.col("doc_id")).collect() == []


def test_toxicity_learns_rare_words_and_from_few_rows(spark):
    r = random.Random(3)
    words = [f"{a}{b}{c}" for a in "klmnp" for b in "aeiou" for c in "rstvz"]
    text = lambda *odd: " ".join(r.sample([*(r.choice(words) for _ in range(30)), *odd], 30 + len(odd)))
    # a hot source with words of its own, and one of a hundredth of the toxic texts with another
    rows = [(i, text("hotvile", "hotbad"), 1) for i in range(1000)] + [(1000 + i, text("qurzslur", "qurzig"), 1) for i in range(10)] + [(2000 + i, text(), 0) for i in range(1010)]
    asked = spark.createDataFrame([(k, text("qurzslur", "qurzig") if k % 2 else text(), "x", 0.0) for k in range(20)], SCHEMA)
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.score(asked, toxicity.train(docs, labels), F.col("doc_id")).collect()
    assert [x.predicted for x in sorted(got)] == [0, 1] * 10
    assert all(1000 <= x.evidence[0] < 1010 for x in got if x.doc_id % 2)
    few = labels.where("doc_id < 10 or doc_id >= 2000 and doc_id < 2010")
    asked = spark.createDataFrame([(k, text("hotvile", "hotbad") if k % 2 else text(), "x", 0.0) for k in range(20)], SCHEMA)
    got = toxicity.score(asked, toxicity.train(docs, few), F.col("doc_id")).collect()
    assert [x.predicted for x in sorted(got)] == [0, 1] * 10


def test_toxicity_short_and_common_lists_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "COMMON", 0.2)
    r = np.random.default_rng(6)
    rows = [(np.flatnonzero(m), r.random(int(m.sum())) + 0.1) for m in r.random((90, 200)) < np.linspace(0.01, 0.4, 200)]
    index = toxicity.Index(np.arange(200, dtype=np.uint64), np.linspace(3, 1, 200), rows, np.arange(90) % 2, np.ones(90), np.arange(90))
    assert 0 < (index.slot >= 0).sum() < 200
    units = np.zeros((90, 200))
    for k, (at, w) in enumerate(rows):
        units[k, at] = index._unit(at, w)
    for k in range(30):
        at, cos = index.nearest(rows[k][0], index._unit(*rows[k]), 5)
        assert np.allclose(cos, np.sort(units @ units[k])[::-1][:5], atol=1e-5) and index.ids[at[0]] == k


def plain_scores(docs, labels, asked):
    """Votes of the nearest examples, every cosine from plain dictionaries; the curve is the library's own."""
    marks = {}
    for i, y in labels:
        if y in (0, 1) and i is not None:
            marks[i] = max(y, marks.get(i, 0))
    seen = {}
    for i, t in docs:
        if t is not None and i in marks:
            seen.setdefault((t, marks[i]), i)
    bag = lambda t: [(w, n) for w, n in Counter(x for w in re.split(r"[^0-9A-Za-z\x80-\U0010ffff]+", t.lower()) if w for x in {w, *([(4, w[:4])] if len(w) > 4 else []), *([(5, w[:5])] if len(w) > 5 else [])}).items()]
    rows = [(bag(t), y, i) for (t, y), i in seen.items()]
    total, n1 = len(rows), sum(y for _, y, _ in rows)
    n0, a, b = total - n1, Counter(), Counter()
    for terms, y, _ in rows:
        for w, _ in terms:
            (a if y else b)[w] += 1
    weight = {}
    for w in {*a, *b}:
        odd = a[w] * (n0 - b[w]) - b[w] * (n1 - a[w])
        told = abs(odd) / np.sqrt((a[w] + b[w]) * (total - a[w] - b[w] + 1) * (n1 + 1) * (n0 + 1)) + 1 / (1 + total)
        weight[w] = (np.log((1 + total) / (1 + a[w] + b[w])) + 1) * told

    def unit(terms):
        v = {w: (1 + np.log(n)) * weight[w] for w, n in terms if w in weight}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if v else {}

    units = [(unit(t), y, i) for t, y, i in rows]

    def vote(v, but=None):
        cos = sorted(((sum(x * u.get(w, 0.0) for w, x in v.items()), y, i) for u, y, i in units if i != but), key=lambda c: (-round(c[0], 6), c[2]))[:12]
        cos = [c for c in cos if c[0] > 1e-6]
        return [1.0, sum(c * y for c, y, _ in cos) / sum(c for c, _, _ in cos), cos[0][0]] if cos else [1.0, 0.0, 0.0]

    votes = [(vote(u, i), y) for u, y, i in units if u]
    curve = toxicity._curve(np.array([v for v, _ in votes]), np.array([y for _, y in votes]), np.ones(len(votes)))
    return [float(1 / (1 + np.exp(-np.clip(np.dot(vote(unit(bag(t))), curve), -30, 30)))) for t in asked]


def test_toxicity_score_equals_plain_votes(spark):
    r = random.Random(8)
    words = [f"{a}{b}{c}xyz" for a in "klmn" for b in "aeiou" for c in "rst"]
    text = lambda *odd: " ".join([*(r.choice(words) for _ in range(25)), *odd])
    docs = [(i, text("vilebad", "vileworse") if i % 3 == 0 else text("finegood")) for i in range(150)]
    labels = [(i, int(i % 3 == 0)) for i in range(150)] + [(3, 0), (None, 1), (4, None)]
    asked = [text("vilebad"), text("vileworse", "finegood"), text(), text("finegood"), docs[0][1]]
    model = toxicity.train(spark.createDataFrame([(i, t, "x", 0.0) for i, t in docs], SCHEMA), spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int"))
    got = sorted(toxicity.score(spark.createDataFrame([(k, t, "x", 0.0) for k, t in enumerate(asked)], SCHEMA), model, F.col("doc_id")).collect())
    want = plain_scores(docs, labels, asked)
    assert [g.score for g in got] == pytest.approx(want, abs=2e-3)


def test_toxicity_with_clashing_columns_and_very_long_texts(spark, monkeypatch):
    r = random.Random(4)
    words = [f"word{k}" for k in range(50)]
    rows = [(i, " ".join([r.choice(words) for _ in range(20)] + ["vilebad"] * (i % 2)), i, 0.5, i, "t", [1]) for i in range(200)]
    rows += [(500, "word1 word2 " * 100_000 + "vilebad " * 30_000, 1, 0.1, 1, "", None), (None, None, None, None, None, None, None), (501, "", 0, 0.0, 0, "", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, share double, y long, key string, term array<int>").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, "k", 1.0) for i in range(200)], "doc_id long, toxic int, text string, share double")
    for most in (toxicity.TERMS, 2000):  # all examples, and a part of them
        monkeypatch.setattr(toxicity, "TERMS", most)
        model = toxicity.train(docs, labels)
        got = {x.doc_id: x.predicted for x in toxicity.score(docs, model, F.col("doc_id")).collect()}
        assert len(got) == 203 and all(got[i] == i % 2 for i in range(200)) and got[501] == 0
        left = toxicity.reject(docs, model)
        assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == {i for i, p in got.items() if not p}
    assert len(model.index.value.y) < 150
