"""Personal identifiers against plain regular expressions, and the added ones."""

import hashlib
import random
import re

from corpusloom.llm import pii

SCHEMA = "doc_id long, text string, lang string, spans string, row int"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = {}
    for kind, p in PLAIN.items():
        out[kind] = []
        for m in re.finditer(p, text, re.A):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    r = random.Random(9)
    bits = ["a@b.c", "@", ".", "x.y%z@q-r.st.uv", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6", "007.0.0.1", "4111 1111 1111 1111", "4111-1111 1111-1112", "5500005555555559", "+1 (988) 555-2485", "+12", "+1--2", "12", "-", " ", "é", "😀", "word", "\n", "a@b.c@d.e%f@g.h", "1 2 3  4", "+", "("]
    out = ["".join(r.choice(bits) for _ in range(r.randrange(1, 40))) for _ in range(400)]
    return out + ["", "a" * 200_000, "1" * 50_000, "1 " * 4_000, "+" * 50_000, "+1" + "-" * 50_000, "a.b" * 40_000 + "@x", "1.1.1.1 " * 300]


def test_fixed_forms(spark):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(texts())] + [(None, None, None, None, None), (3, texts()[3], None, None, None)]
    got = pii.find(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain((texts()[r.doc_id]) if r.doc_id is not None else "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in want.values()], r.doc_id
        joined = ",".join(x for v in want.values() for x in v)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))
    assert pii.find(spark.createDataFrame([], SCHEMA)).collect() == []


def test_context_adds_unseen_identifiers(spark):
    r = random.Random(4)
    filler = lambda: " ".join(r.choice("alpha beta gamma delta eps zeta".split()) for _ in range(8))
    rows = [(i, f"{filler()} write mailbox: user{i}@host{i % 9}.org {filler()} item {r.randrange(99)} {filler()}", "x", "s", 1) for i in range(120)]
    rows += [(200, f"{filler()} mailbox: admin@intranet {filler()}", "x", "s", 1), (201, f"{filler()} ratio x@y {filler()}", "x", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x for x in pii.find(docs).collect()}
    at = rows[120][1].index("admin@intranet")
    assert got[200].spans == f"email:{at}:{at + 14}" and got[200].n_email == 0 and got[200].n_added == 1
    assert got[201].spans == "" and all(got[i].n_added == 0 for i in range(120))
    masked = {x.doc_id: x.text for x in pii.mask(docs).collect()}
    assert masked[200] == rows[120][1].replace("admin@intranet", "<EMAIL>") and "<EMAIL>" in masked[3] and masked[201] == rows[121][1]


def test_mask(spark):
    rows = [(1, "to +1 (988) 555-2485, a@b.c!", None, "s", 1), (2, None, None, None, None), (3, "", None, None, None)]
    out = pii.mask(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "spans", "row"]
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["to <PHONE>, <EMAIL>!", None, ""]
