"""Typed records: round trips, edits by hand and malformed notes."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.sources import typed as T

TEXTS = st.text(max_size=40)


@st.composite
def records(draw):
    kind = draw(st.sampled_from(sorted(T.FIELDS)))
    value = {"string": TEXTS, "text": TEXTS, "number": st.floats(-1e6, 1e6) | st.sampled_from(["1,020.5", " 7 "]), "boolean": st.booleans() | st.just("true"), "date": st.dates().map(str) | st.just("2026-05-01 10:30:12Z"), "list": st.lists(TEXTS, max_size=4)}
    fields = {}
    for name, sort in draw(st.lists(st.sampled_from(sorted(T.FIELDS[kind].items())), max_size=6, unique=True)):
        got, error = T.clean_field(kind, name, draw(value[sort]))
        assert error is None
        if got not in (None, []):
            fields[name] = got
    line = lambda n: T.clean_string(draw(TEXTS), n) or None
    return {
        "path": "a/b.md", "id": T.clean_string(draw(TEXTS), 80) or "x", "kind": kind, "title": line(300) or "b", "state": line(40) or T.SPECS[kind][0] or "-", "start": draw(st.none() | st.dates().map(str)), "end": draw(st.none() | st.just("2026-01-02T10:30")),
        "place": line(300), "source": line(60), "account": line(60), "observed": line(40), "updated": line(40), **{k: T.clean_list(draw(st.lists(TEXTS, max_size=4))) for k in ("refs", "threads", "not_threads", "counterparts")},
        "fields": fields, "errors": [], "body": draw(TEXTS), "human_edited": False, "extra": {k: json.dumps(v, ensure_ascii=False) for k, v in draw(st.dictionaries(st.sampled_from(["tags", "cssclass", "mine too"]), st.text(max_size=9) | st.lists(TEXTS, max_size=3))).items() if v not in ("", [])},
    }


@settings(max_examples=300, deadline=None)
@given(records())
def test_parse_undoes_serialize(r):
    got = T.parse(r["path"], T.serialize(r))
    got.pop("state_known")
    assert got == r and T.serialize(got) == T.serialize(r)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="---\n: ab[]\"'{}-type#0é", max_size=120))
def test_nothing_makes_parsing_fail(text):
    assert T.parse("x.md", text) is None
    T.parse("x.md", f"---\ntype: bill\nagent-id: 7\n{text}\n---\n{text}")


def test_values_or_errors_and_edits():
    note = "---\ntype: bill\nagent-id: b1\nstate: Paid\namount: 1,020.505\nautopay: maybe\ndue: soon\npaid-on: 2026-02-01T10:00:00+01:00\npayee:   Power  Co \ntags:\n  - mine\n  - two words\ncounterparts: [a@b.c, 'd']\n---\nbody\n"
    r = T.parse("Bills/Power.md", note)
    assert r["fields"] == {"amount": 1020.51, "paid-on": "2026-02-01T10:00", "payee": "Power Co"} and r["errors"] == ['field "autopay" is not true/false', 'field "due" is not an ISO date']
    assert (r["title"], r["counterparts"], r["extra"], r["human_edited"], r["state_known"]) == ("Power", ["a@b.c", "d"], {"tags": '["mine", "two words"]'}, False, True)
    written = T.serialize(r)
    edited = lambda text: T.parse("Bills/Power.md", text)["human_edited"]
    assert not edited(written) and edited(written.replace("1020.51", "1020.52")) and edited(written.replace("body", "body of mine"))
    # what other tools add is no edit, nor is another order or way to write it
    lines = written.split("\n")
    assert not edited(written.replace("---\n", "---\nflag: true\n", 1)) and not edited("\n".join([lines[0], lines[2], lines[1], *lines[3:]])) and not edited(written.replace('"Power Co"', "Power Co"))
    assert T.parse("x.md", "---\ntype: note\nagent-id: 1\n---\n") is None and T.parse("x.md", "---\ntype: bill\n---\n") is None and T.parse("x.md", None) is None
    assert [T.valid_state("bill", s) for s in ("Paid", "open", "", None)] == ["paid", None, None, None] and T.valid_state("bill", "held-back", True) == "held-back" and T.valid_state("person", "Friend") == "friend"
    assert T.clean_field("task", "amount", 1)[1] == 'unknown field "amount" for task'


def test_records_of_a_table(spark):
    rows = [(f"Agent/Bills/{k}.md", f"---\ntype: bill\nagent-id: {k}\namount: {k}.5\ntags: [a]\n---\nx{k}") for k in range(20)] + [("Agent/Log/l.md", "---\ntype: bill\nagent-id: 9\n---\n"), ("Agent/_review/r.md", None), ("Other/o.md", "---\ntype: bill\nagent-id: 9\n---\n"), ("Agent/n.md", "plain")]
    notes = T.stored(spark.createDataFrame(rows, "path string, content string"), "Agent")
    got = T.parse_records(notes).cache()
    assert sorted((r.id, r.fields["amount"], r.extra["tags"]) for r in got.collect()) == sorted((str(k), f"{k}.5", '["a"]') for k in range(20))
    again = T.parse_records(T.serialize_records(got))
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
