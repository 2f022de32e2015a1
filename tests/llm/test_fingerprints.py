"""Fingerprints against a plain version, and likeness against exact Jaccard similarity."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as e
from corpusloom.llm import fingerprints as fp
from corpusloom.llm.blocks import mix, shingles, words

SCHEMA = "doc_id long, text string, part string, last int, down array<int>, fingerprint string"


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(text):
    """Bin by bin: the least hash of each, then for each empty one the first full one in its order."""
    w, at = words(pa.array([text or ""]))[:2]
    h = [int(x) for x in shingles(w[at[0] : at[1]], 5)]
    if not h:
        return ""
    least = {}
    for x in h:
        least[x >> 55] = min(x, least.get(x >> 55, x))
    nibbles = []
    for i in range(512):
        x = least.get(i)
        if x is None:
            order = sorted(least, key=lambda j, i=i: int(mix(np.array([i * 512 + j], np.uint64), 12)[0]))
            x = int(mix(np.array([(least[order[0]] + i) % 2**64], np.uint64), 21)[0])
        nibbles.append(x & 15)
    return base64.b64encode(bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))).decode()


def some_text(r, n):
    return " ".join(r.choice(["alpha", "Beta", "gämma", "delta", "x", "yy", "zeta", "eta"]) + str(r.randrange(40)) for _ in range(n))


def test_fingerprint_equals_plain_version(spark):
    r = random.Random(2)
    texts = [None, "", " \n ", "one", "ONE", "a b c d", "a b c d e f", some_text(r, 3), some_text(r, 12), some_text(r, 300)]
    rows = [(k, t, "x", 1, None, "y") for k, t in enumerate(texts)]
    got = {g.doc_id: g.fingerprint for g in fp.fingerprints(spark.createDataFrame(rows + [rows[-1]], SCHEMA), "doc_id").collect()}
    assert got == {k: plain(t) for k, t in enumerate(texts)}
    assert got[0] == got[1] == got[2] == "" and got[3] == got[4]
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA), "doc_id").collect() == []


def test_likeness_is_near_jaccard_and_unbiased():
    r, off = random.Random(5), []
    for n in (6, 30, 200, 3000):
        for keep in (0.0, 0.3, 0.6, 0.9, 1.0):
            for _ in range(12):
                a = some_text(r, n).split()
                k = int(n * keep)
                b = a[:k] + some_text(r, n - k).split()
                x, y = fp.sketch(pa.array([" ".join(a), " ".join(b)]))
                off.append((n, fp.likeness(x, y) - jaccard(" ".join(a), " ".join(b))))
    error = np.array([x for _, x in off])
    assert abs(error.mean()) < 0.01 and np.abs(error).mean() < 0.02 and np.abs(error).max() < 0.12


def edited(rows):
    """``doc_id, text, edited, next text`` by a sort."""
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    out = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 3
        out.append((i, t, t[: len(t) - k] + u[:k], u))
    return out


@pytest.mark.parametrize("many", [0, 1, 2, 400])
def test_edit_report(spark, monkeypatch, many):
    monkeypatch.setattr(fp, "RANGE", 16)
    r = random.Random(many)
    texts = [None, "", "ä𝄞é" * 7, "word " * 30000, "same same text that is there more than once"]
    rows = [(k * k - 50, r.choice(texts) if r.random() < 0.3 else some_text(r, r.randrange(40))) for k in range(many)]
    if many > 2:
        rows += [(None, "no id"), (2**62, "far away"), (-(2**63), "farther")]
    df = spark.createDataFrame([(i, t, "p", 1, None, "f") for i, t in rows], SCHEMA).repartition(5)
    got = {g.doc_id: g for g in fp.edit_report(df).collect()}
    assert len(got) == len(rows)
    want = edited(rows)
    marks = fp.sketch(pa.array([x for w in want for x in w[1:]], pa.string()))
    for k, (i, t, x, _) in enumerate(want):
        a, b, c = marks[3 * k : 3 * k + 3]
        assert got[i] == (i, len(t), hashlib.sha256(x.encode()).hexdigest(), base64.b64encode(a).decode(), base64.b64encode(b).decode(), fp.likeness(a, b), fp.likeness(a, c))


def test_repeated_and_unnamed_rows_all_come_out(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE", 8)
    rows = [(k % 10 if k % 3 else None, f"text {k % 7} of some words in all here", "p", 1, None, "f") for k in range(300)]
    got = fp.edit_report(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted((g.doc_id, g.n_chars) for g in got if g.doc_id is not None) == sorted((i, len(t)) for i, t, *_ in rows if i is not None)
    assert sum(g.doc_id is None for g in got) == 100
    again = fp.edit_report(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_likeness_of_pairs(spark):
    marks = [base64.b64encode(x).decode() for x in fp.sketch(pa.array(["a b c d e f g", "a b c d e f h", "", "other words"]))]
    rows = [(marks[0], marks[0]), (marks[0], marks[3]), (marks[2], marks[2]), (marks[2], marks[0]), (None, marks[0])]
    got = [g.likeness for g in fp.with_likeness(spark.createDataFrame(rows, "a string, b string").coalesce(1), "a", "b").collect()]
    assert got[0] == 1.0 and got[1] < 0.15 and got[2:] == [1.0, 0.0, None]


def test_query_reports_every_document(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {g.doc_id: g for g in e.queries()["op12_fingerprints"](spark, sf).collect()}
    assert len(got) == len(docs)
    off = []
    for i, t, x, u in edited(docs):
        assert got[i].edited_sha256 == hashlib.sha256(x.encode()).hexdigest() and got[i].n_chars == len(t)
        off += [got[i].near_edited - jaccard(t, x), got[i].near_next - jaccard(t, u)]
    assert np.abs(off).mean() < 0.02 and np.abs(off).max() < 0.15
