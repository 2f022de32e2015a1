"""Fill-in-middle against a plain version on strings."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import infill

from .oracle import frames

SCHEMA = "doc_id long, text string, n string, form int, h array<int>"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, unit="token"):
    text = text or ""
    s = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    t = TOKEN.findall(text) if unit == "token" else list(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(t), "plain", None, None, text
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, len(t), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


TEXTS = [None, "", " ", "\n\t  ", "a", " a", "a ", "  a  b\x0b\x0cc  ", "ä ö ü \U0001d11e\U0001d11e x", "x <S> y", "a <P", "S> <", "<M> a", "ab < c S> d <M e", "  em space ", "wort " * 20000, "é" * 30000, "𝄞 " * 9999, "<" * 50]


def test_transform_on_odd_texts(spark):
    rows = [(i * 100 + k, t, None, 1, None) for i in range(12) for k, t in enumerate(TEXTS)] + [(None, "null id kept", "x", 1, None), (7, "twice in it", "x", 1, None), (7, "twice in it", "x", 1, None), (-5, "minus five", "", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for unit in ("token", "char"):
        got = infill.transform(df, unit=unit).collect()
        assert sorted(map(tuple, got), key=repr) == sorted((plain(i, t, unit) for i, t, *_ in rows), key=repr)
    assert len({r.form for r in got}) == 3
    assert infill.transform(spark.createDataFrame([], SCHEMA)).collect() == []


def test_report_has_digests_of_output_and_text(spark):
    rows = [(i, t, None, 1, None) for i, t in enumerate(TEXTS * 5)]
    got = {r.doc_id: r for r in infill.transform(spark.createDataFrame(rows, SCHEMA), infill.REPORT).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert all(got[i].restored_sha256 == sha(t) and got[i].output_sha256 == sha(plain(i, t)[-1]) for i, t, *_ in rows)


def test_op13_sql(spark):
    a, b = frames(spark, "op13_fill_in_middle", "/root/testdata/sf0.01")
    assert a == b


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a é€𝄞\n", max_size=60))
def test_exceptions_convert_both_ways(text):
    data = np.frombuffer(text.encode(), np.uint8)
    index = infill.Exceptions(data)
    at = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert index.bytes(np.arange(len(text) + 1)).tolist() == at.tolist()
    assert index.chars(at).tolist() == list(range(len(text) + 1))
    assert len(index.byte) == sum(c > "\x7f" for c in text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a<PSM> ", max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]))
def test_every_form_is_undone(text, a, b, form):
    raw = text.encode()
    if any(m in raw for m in infill.MARKERS):
        return
    a, b = sorted((min(a, len(raw)), min(b, len(raw))))
    assert infill.restored(infill.arranged(raw, form, a, b), form) == raw
