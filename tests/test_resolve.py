"""Staged resolution against plain loops over all records of a kind."""

import datetime as dt
import random
import re

import pytest

from corpusloom.operators import resolve as Z
from corpusloom.operators.records import SPECS


def ref(s):
    return re.sub("[^A-Z0-9]", "", (s or "").upper())


def plain(s):
    return "".join(c for c in (s or "").lower() if c.isalnum())


def tokens(s, stop):
    return {t for t in re.findall(r"[^\W_]{3,}", (s or "").lower()) if t not in stop}


def match(a, b):
    x, y = sorted((plain(a), plain(b)), key=len)
    return bool(x) and (x == y or (len(x) >= 4 and x in y))


def agree(a, b):
    if not (a or "").strip() or not (b or "").strip():
        return None
    if match(a, b):
        return True
    x, y = sorted((tokens(a, Z.TITLE_STOP), tokens(b, Z.TITLE_STOP)), key=len)
    return None if not x else x <= y


def places(a, b):
    return bool(tokens(a, Z.PLACE_STOP) & tokens(b, Z.PLACE_STOP))


def service(a, b):
    x, y = ref(a), ref(b)
    if not x or not y:
        return None
    if x == y:
        return True
    p, r = (re.sub("^[A-Z]*0*", "", s) for s in (x, y))
    a, b = (re.match("[A-Z]*", s)[0] for s in (x, y))
    return p.isdigit() and p == r and (not a or not b or a == b)


def way(q, f):
    four = (q["from"], q["to"], f.get("from"), f.get("to"))
    if not all(four):
        return None
    if places(four[0], four[2]) and places(four[1], four[3]):
        return True
    return False if places(four[0], four[3]) and places(four[1], four[2]) else None


def number(day):
    return dt.date.fromisoformat(day[:10]).toordinal() if day else None


def minutes(day):
    return int(day[11:13]) * 60 + int(day[14:16]) if day and len(day) > 10 else None


def people(items):
    out = set()
    for x in items or []:
        if not x.strip():
            continue
        at = re.search(r"<?([^\s<>@]+@[^\s<>@]+)>?", x.lower())
        address = at[1] if at else x.lower().strip()
        out.add("at:" + address)
        local = x.split("@")[0]
        digits = re.sub(r"\D", "", local)
        if not re.search("[a-zA-Z]", local) and len(digits) >= 7:
            out.add("tel:" + digits[-9:])
        domain = ".".join(address.split("@")[-1].split(".")[-2:])
        if "." in domain and domain not in ("gmail.com",):
            out.add("of:" + domain)
    return out


def judged(r, q):
    """``positives, excluded, conflict, leg, same day`` of one pair."""
    f, kind = r["fields"] or {}, r["kind"]
    day = None if not q["date"] or not r["start"] else q["date"][:10] == r["start"][:10]
    apart = None if minutes(q["date"]) is None or minutes(r["start"]) is None else abs(minutes(q["date"]) - minutes(r["start"]))
    s, w = service(q["number"], f.get("number")), way(q, f)
    leg = "other" if s is False or w is False else "same" if s or w else "unknown"
    known = bool(people(q["counterparts"]) & people((r["counterparts"] or []) + ([f.get("email", ""), f.get("contact", "")] if kind == "activity" else [])))
    pos, out, conflict = [], False, False
    if kind == "transport":
        pos = ["number"] * bool(s) + ["route"] * bool(w)
        if not pos and day and apart is not None and apart <= 15:
            pos = ["time"]
        out = s is False or w is False or day is False
    elif kind == "stay":
        named = agree(q["name"], f"{r['title'] or ''} {f.get('lodging', '')}")
        a, b, over = number(q["date"]), number(q["end"]), None
        nights = bool(a and b and b > a)
        if a and r["start"]:
            lo = number(r["start"])
            hi = max(number(r["end"] or r["start"]), lo)
            over = a < max(hi, lo + 1) and b > lo if nights else lo <= a <= hi
        out = over is False or named is False
        conflict = bool(named is False and over and nights)
        if not out:
            pos = ["name"] * bool(named) + [("nights" if nights else "date")] * bool(over)
            if pos == ["date"]:
                pos = []
    elif kind == "activity":
        here = " ".join(x for x in (r["place"], f.get("address"), f.get("provider")) if x is not None)
        if agree(q["name"], r["title"]) and (apart is None or apart <= 120):
            pos = ["name"]
        elif apart is not None and apart <= 30 and q["place"] and places(q["place"], here):
            pos = ["time", "place"]
        pos += ["counterpart"] * known
        pos = ["date"] * bool(day and pos) + pos  # a message about that day from those who run it
        out = day is False
    else:
        anchor = r["start"] or f.get("due")
        if q["date"] and anchor:
            tol = SPECS[kind][2]
            fit = number(q["date"]) <= number(r["end"] or anchor) + tol and number(q["end"] or q["date"]) >= number(anchor) - tol
            pos, out = ["date"] * fit, not fit
        here = " ".join(x for x in (r["place"], f.get("destination"), f.get("city"), f.get("venue")) if x is not None)
        if q["place"] and here.strip():
            if places(q["place"], here):
                pos.append("place")
            else:
                out = out or kind == "trip"
        if kind == "conference":
            named = agree(q["name"], r["title"])
            pos += ["name"] * bool(named)
            out = out or named is False
        pos += ["counterpart"] * known
        if kind == "bill":
            if q["payee"] and f.get("payee"):
                ok = match(q["payee"], f["payee"])
                pos += ["payee"] * ok
                out = out or not ok
            if q["period"] and f.get("period"):
                ok = q["period"].lower() == f["period"].lower()
                pos += ["period"] * ok
                out = out or not ok
            if q["amount"] is not None and f.get("amount") and abs(q["amount"] - float(f["amount"])) < 0.005:
                pos.append("amount")
    return pos, out, conflict, leg, day


def answer(records, q):
    pool = [r for r in records if r["kind"] == q["kind"] and not (q["thread"] and q["thread"] in (r["not_threads"] or []))]
    refs = {ref(x) for x in q["refs"] or [] if len(ref(x)) >= 4}
    hard = [r for r in pool if (q["thread"] and q["thread"] in (r["threads"] or [])) or refs & {ref(x) for x in r["refs"] or []}]
    ids = lambda rs: sorted(r["id"] for r in rs)[:6]
    if q["kind"] == "transport":
        legs = [r for r in hard if judged(r, q)[3] != "other"]
        if legs:
            day = [r for r in legs if judged(r, q)[4] is not False] if q["date"] else legs
            if len(day) == 1:
                return "exact", day[0]["id"], None
            if day:
                return "several", None, ids(day)
            moved = [r for r in legs if judged(r, q)[3] == "same"]
            return ("exact", moved[0]["id"], None) if len(moved) == 1 else ("several", None, ids(legs))
    elif hard:
        return ("exact", hard[0]["id"], None) if len(hard) == 1 else ("several", None, ids(hard))
    scored = [(r, *judged(r, q)[:3]) for r in pool if q["include_closed"] or r["state"] not in SPECS[q["kind"]][1]]
    fitting = [(r, p) for r, p, out, _ in scored if p and not out]
    strong = [r for r, p in fitting if set(p) != {"counterpart"}]
    if len(strong) == 1:
        return "unique", strong[0]["id"], None
    if not strong and any(c for *_, c in scored):
        return "several", None, ids([r for r, _, _, c in scored if c])
    several = strong or [r for r, _ in fitting]
    return ("several", None, ids(several)) if several else ("none", None, None)


def some(n, seed, kinds):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    day = lambda: pick(None, *(f"2026-0{r.randrange(1, 4)}-{r.randrange(1, 29):02d}" + pick("", f"T{r.randrange(8, 20):02d}:{r.choice('0135')}0") for _ in range(6)))
    towns = ["London", "New York", "Berlin city", "Paris airport", "Oslo", "", None]
    names = ["Hotel Aurora", "Aurora", "The Megaro Hotel", "Megaro", "Grand Palace", "Data Summit 2026", "Summit", "", None, "hotel", "boat-tour", "Boat Tour deluxe"]
    who = ["anna@firm.example.com", "Bob <bob@firm.example.com>", "eve@gmail.com", "+44 20 7946 0958", "020 7946 0958", " "]
    several = lambda x: pick(None, [], [r.choice(x)], [r.choice(x), r.choice(x)])
    codes = [f"AB-{k}234" for k in range(40)] + ["x1", "ab 3 234"]

    def later(d):
        return None if d is None or r.random() < 0.4 else (dt.date.fromisoformat(d[:10]) + dt.timedelta(r.randrange(0, 6))).isoformat()

    records, queries = [], []
    for k in range(n):
        kind, start = r.choice(kinds), day()
        fields = {x: v for x, v in {"number": pick(None, "UA 949", "BA949", "949", "BA 12", "TGV"), "from": pick(*towns), "to": pick(*towns), "lodging": pick(None, "Aurora", ""), "payee": pick(None, "Power Co", "power company", "Water"), "period": pick(None, "2026-01", "2026-02"), "amount": pick(None, "40", "40.004", "12.5", "no"), "due": day(), "city": pick(None, "Oslo"), "address": pick(None, "Pier 4"), "email": pick(None, "eve@gmail.com")}.items() if v is not None and r.random() < 0.7}
        if fields.get("amount") == "no":
            fields.pop("amount")
        states = [s for s in (SPECS[kind][0], *SPECS[kind][1]) if s] or [None]
        records.append({"id": k, "kind": kind, "state": pick(states[0], *states), "title": pick(*names), "refs": several(codes), "threads": pick(None, [], [f"t{r.randrange(60)}"]), "not_threads": pick(None, [], [f"t{r.randrange(6)}"]), "start": start, "end": later(start), "place": pick(*towns, "Pier"), "counterparts": several(who), "fields": fields})
        start = day()
        queries.append({"q": k, "kind": r.choice(kinds), "thread": pick(None, "", f"t{r.randrange(60)}"), "refs": pick(None, None, several(codes)), "name": pick(*names), "date": start, "end": later(start), "place": pick(*towns, "Pier 9"), "counterparts": pick(None, None, several(who)), "number": pick(None, None, "UA949", "949", "ba 0012"), "from": pick(*towns), "to": pick(*towns), "payee": pick(None, "Power Co.", "water works"), "period": pick(None, "2026-01"), "amount": pick(None, 40.0, 12.5), "include_closed": pick(None, False, True)})
    return records, queries


@pytest.mark.parametrize("kinds", [["transport"], ["stay"], ["activity", "bill"], ["trip", "conference", "appointment", "task"]])
def test_resolve_equals_plain_loops(spark, kinds):
    records, queries = some(160, len(kinds[0]), kinds)
    want = {q["q"]: answer(records, q) for q in queries}
    rows = lambda items, schema: spark.createDataFrame([tuple(x[c.split()[0]] for c in re.split(r", (?=[a-z_]+ )", schema)) for x in items], schema)
    got = {x.q: (x.answer, x.id, x.candidates) for x in Z.resolve(rows(records, Z.RECORDS), rows(queries, Z.QUERIES)).collect()}
    wrong = [(k, got.get(k), want[k]) for k in want if got.get(k) != want[k]]
    assert not wrong, (len(wrong), wrong[:4])
    assert {a for a, *_ in want.values()} == {"exact", "unique", "several", "none"}
