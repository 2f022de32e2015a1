"""Typed records as markdown notes: read with a value or an error for each field, written with a stamp that tells edits by hand.

Each note is read by itself in its task. What isn't a record gives no row, and nothing in a note makes
reading fail. Properties that other tools have added stay as they are and aren't part of the stamp.
"""

from __future__ import annotations

import hashlib
import json
import re
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.operators.records import SPECS

# The states of each kind (none: any short text), and the fields of each kind by type.
STATES = {
    "appointment": "offered requested confirmed rescheduled attended cancelled",
    "trip": "planned booked changed done cancelled",
    "conference": "planned registered done cancelled",
    "transport": "planned offered booked changed done cancelled",
    "stay": "planned offered booked changed done cancelled",
    "activity": "planned offered to-confirm asked confirmed done cancelled",
    "bill": "issued scheduled paid overdue",
    "task": "proposed open waiting done dropped",
    "project": "",
    "person": "",
}
_COST = "price:number currency:string payment:string paid:boolean"
_ITINERARY = "trip:string hub:string tickets:list url:string notes:text sensitive:boolean booking:text"
_FIELDS = {
    "appointment": f"category:string with:string phone:string url:string address:string travel-min:number sensitive:boolean booking:text options:text {_COST}",
    "trip": "destination:string country:string hub:string notes:text",
    "conference": f"venue:string city:string country:string schedule-url:string {_ITINERARY} {_COST}",
    "transport": f"mode:string carrier:string number:string from:string to:string seat:string travel-min:number arrive-by:date {_ITINERARY} {_COST}",
    "stay": f"lodging:string address:string country:string check-in:string check-out:string phone:string email:string {_ITINERARY} {_COST}",
    "activity": f"category:string address:string provider:string with:string contact:string email:string confirm-via:string confirm-by:date travel-min:number arrive-by:date options:text conference:string official:boolean {_ITINERARY} {_COST}",
    "bill": "payee:string amount:number currency:string due:date period:string autopay:boolean paid-on:date",
    "task": "due:date for:string waiting-on:string",
    "project": "next:string",
    "person": "name:string last-heard:date last-wrote:date reply-owed:boolean channel:string",
}
FIELDS = {kind: dict(x.split(":") for x in spec.split()) for kind, spec in _FIELDS.items()}
# Characters of a string and of a long one, and items of a list.
STRING, TEXT, LIST = 300, 1200, 30
#: Properties of all kinds: strings with their greatest length, lists with that of their items.
_STRINGS = {"title": STRING, "state": 40, "place": STRING, "source": 60, "account": 60, "observed": 40, "updated": 40}
_LISTS = {"refs": 200, "threads": 200, "not-threads": 200, "counterparts": 200}
_OWN = {"type", "agent-id", "start", "end", "authorship", "agent-access", *_STRINGS, *_LISTS}
STAMP = "agent-hash"

#: A record. ``fields`` has each typed field's value as text (numbers in full, lists as JSON); ``extra`` what other tools have added, as written.
RECORD = "path string, id string, kind string, title string, state string, state_known boolean, start string, end string, place string, source string, account string, observed string, updated string, refs array<string>, threads array<string>, not_threads array<string>, counterparts array<string>, fields map<string,string>, errors array<string>, body string, human_edited boolean, extra map<string,string>"


def clean_string(value, most: int = STRING) -> str:
    """One line without control characters, white space single, at most so long."""
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        return ""
    return " ".join(re.sub(r"[\x00-\x1f\x7f  ]+", " ", str(value)).split())[:most].rstrip()


def clean_list(value, most: int = LIST, width: int = 200) -> list[str]:
    items = value if isinstance(value, list) else [value] if isinstance(value, str) else []
    return list(dict.fromkeys(filter(None, (clean_string(x, width) for x in items))))[:most]


def clean_date(value) -> str | None:
    """A day, or a day with a time to the minute; seconds and zone go."""
    s = re.sub(r"(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})$", "", value.strip()).replace(" ", "T", 1) if isinstance(value, str) else ""
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}(:[0-9]{2})?)?", s):
        return None
    try:
        date.fromisoformat(s[:10])
    except ValueError:
        return None
    return s[:16]


def clean_field(kind: str, name: str, value) -> tuple[object, str | None]:
    """``value, error`` of a field; neither if it is empty."""
    sort = FIELDS[kind].get(name)
    if sort is None:
        return None, f'unknown field "{clean_string(name, 40)}" for {kind}'
    if value is None or value == "":
        return None, None
    if sort in ("string", "text"):
        return clean_string(value, TEXT if sort == "text" else STRING) or None, None
    if sort == "number":
        try:
            n = float(re.sub(r"[,\s]", "", str(value)))
            if isinstance(value, bool) or n != n or abs(n) == float("inf"):
                raise ValueError
            return int(n * 100 + (0.5 if n >= 0 else -0.5)) / 100, None
        except ValueError:
            return None, f'field "{name}" is not a number'
    if sort == "boolean":
        known = value if isinstance(value, bool) else {"true": True, "false": False}.get(value) if isinstance(value, str) else None
        return known, None if known is not None else f'field "{name}" is not true/false'
    if sort == "date":
        day = clean_date(value)
        return day, None if day else f'field "{name}" is not an ISO date'
    return clean_list(value), None


def _value(raw: str):
    """What is written behind a key: JSON where it is that, else a plain list or text."""
    raw = raw.strip()
    try:
        got = json.loads(raw)
        if isinstance(got, (str, bool, int, float, list)):
            return got if not isinstance(got, list) else [x if isinstance(x, str) else json.dumps(x) for x in got]
    except ValueError:
        pass
    if raw.startswith("[") and raw.endswith("]"):
        return [x for x in (y.strip().strip("\"'") for y in raw[1:-1].split(",")) if x]
    return raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'" else raw


def properties(text: str) -> tuple[dict, str]:
    """The leading block's properties, the last of each name, and the body; no block, no properties."""
    m = re.match(r"---\r?\n([\s\S]*?)\r?\n?---(?:\r?\n|$)", text)
    if not m:
        return {}, text
    out, open_list = {}, None
    for line in re.split(r"\r?\n", m[1]):
        key, item = re.match(r"([A-Za-z_][\w -]*):(?:\s+(.*))?$", line), re.match(r"\s*-\s+(.*)$", line)
        if item and open_list is not None:
            out[open_list].append(str(_value(item[1])))
        elif key:
            name = key[1].strip()
            open_list = name if not (key[2] or "").strip() else None
            out[name] = [] if open_list else _value(key[2])
    return {k: "" if v == [] and k not in _LISTS else v for k, v in out.items()}, text[m.end() :]


def _stamp(own: dict, body: str) -> str:
    """A hash of the record's own properties, however they are written, and the body."""
    said = {k: v for k, v in own.items() if v not in (None, "", [])}
    return hashlib.sha256(json.dumps([said, body.strip()], sort_keys=True, ensure_ascii=False).encode("utf8", "surrogatepass")).hexdigest()[:16]


def parse(path: str, text: str | None) -> dict | None:
    """A record, or nothing if the note isn't one."""
    data, body = properties(text or "")
    kind, name = data.get("type"), clean_string(data.get("agent-id"), 80)
    if not isinstance(kind, str) or kind not in SPECS or not name:
        return None
    fields, errors, own, extra = {}, [], {}, {}
    for key, value in data.items():
        if key == STAMP:
            continue
        if key not in _OWN and key not in FIELDS[kind]:
            extra[key] = json.dumps(value, ensure_ascii=False)
            continue
        own[key] = value
        if key not in _OWN:
            got, error = clean_field(kind, key, value)
            errors += [error] * (error is not None)
            if got is not None:
                fields[key] = got
    out = {k: clean_string(data.get(k), n) or None for k, n in _STRINGS.items()}
    out["title"] = out["title"] or re.sub(r"\.md$", "", (path or "").rsplit("/", 1)[-1])
    out["state"] = out["state"] or SPECS[kind][0] or "-"
    stamp = clean_string(data.get(STAMP), 40)
    lists = {k.replace("-", "_"): clean_list(data.get(k), width=n) for k, n in _LISTS.items()}
    return {
        "path": path, "id": name, "kind": kind, **out, **lists, "state_known": valid_state(kind, out["state"]) is not None, "start": clean_date(data.get("start")), "end": clean_date(data.get("end")),
        "fields": fields, "errors": errors, "body": body, "human_edited": stamp != "" and _stamp(own, body) != stamp, "extra": extra,
    }


def valid_state(kind: str, state, lenient: bool = False) -> str | None:
    """The state, if its kind has it; any for kinds without a list, and if ``lenient`` any plain word."""
    s = clean_string(state, 40).lower()
    allowed = STATES[kind].split()
    if not s or not allowed or s in allowed:
        return s or None
    return s if lenient and re.fullmatch("[a-z][a-z-]{1,30}", s) else None


def serialize(r: dict) -> str:
    """The note of a record: its properties as JSON values, stamped, then what other tools have added, then the body."""
    own = {"type": r["kind"], "agent-id": r["id"], **{k: r.get(k) for k in ("title", "state", "start", "end", "place")}, **r["fields"]}
    own |= {k: r.get(k.replace("-", "_")) for k in _LISTS} | {"authorship": "agent"} | {k: r.get(k) for k in ("source", "account", "observed", "updated")} | {"agent-access": "local"}
    own = {k: v for k, v in own.items() if v not in (None, "", [])}
    lines = [f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in own.items()] + [f"{STAMP}: {json.dumps(_stamp(own, r['body']))}"]
    lines += [f"{k}: {v}" for k, v in (r.get("extra") or {}).items() if k not in own]
    return "---\n" + "\n".join(lines) + "\n---\n" + r["body"]


def parse_records(notes: DataFrame) -> DataFrame:
    """The records among ``notes`` (path, content), as ``RECORD``; one row for each note that is one."""
    schema = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches):
        for batch in batches:
            rows = [r for r in map(parse, batch.column(0).to_pylist(), batch.column(1).to_pylist()) if r]
            for r in rows:
                r["fields"] = [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in r["fields"].items()]
                r["extra"] = list(r["extra"].items())
            yield pa.RecordBatch.from_pylist(rows, schema)

    return notes.select("path", "content").mapInArrow(run, RECORD)


def serialize_records(records: DataFrame) -> DataFrame:
    """``path, content``: the notes of records as ``RECORD``, stamped as they are now."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                sort = FIELDS[r["kind"]]
                r["fields"] = {k: v if sort.get(k) in ("string", "text", "date") else json.loads(v) for k, v in r["fields"] or []}
                r["extra"] = dict(r["extra"] or [])
                r["body"] = r["body"] or ""
                out.append(serialize(r))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("path")), pa.array(out, pa.string())], ["path", "content"])

    return records.mapInArrow(run, "path string, content string")


def stored(notes: DataFrame, folder: str) -> DataFrame:
    """The notes under a folder that may be records: none of its reviews or logs."""
    inside: Column = F.col("path").startswith(f"{folder}/")
    held = F.col("path").startswith(f"{folder}/_review/") | F.col("path").startswith(f"{folder}/Log/")
    return notes.where(inside & ~held)
