"""Functions on notes: paragraphs, segments, quotes, frontmatter text and the rules that act on them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import predicates as P
from corpusloom.functions import text as T

_BLOCK = r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)"


def parse_query(raw: str) -> dict:
    """``text, phrases, type, folder, since`` of a search line: type:, in: and since: with plain or
    quoted values, phrases in quotes, the rest as words. A query is a parameter, so this is plain Python."""
    out = {"text": "", "phrases": [], "type": None, "folder": None, "since": None}

    def operator(m: re.Match) -> str:
        key = {"in": "folder"}.get(m[1].lower(), m[1].lower())
        out[key] = m[2][1:-1] if len(m[2]) > 1 and m[2][0] == m[2][-1] == '"' else m[2]
        return " "

    rest = re.sub(r'(?i)\b(type|in|since):("[^"]+"|\S+)', operator, raw)
    out["phrases"] = [x.strip() for x in re.findall(r'"([^"]+)"', rest)]
    out["text"] = " ".join(re.sub(r'"[^"]+"', " ", rest).split())
    return out


def parsed_query(raw: Column) -> Column:
    """The same of a column of search lines: ``text, phrases, type, folder, since``; the last of each operator counts."""
    operator = r'(?i)\b(type|in|since):("[^"]+"|\S+)'
    found = F.regexp_extract_all(raw, F.lit(operator), F.lit(0))

    def value(name: str) -> Column:
        last = F.try_element_at(F.filter(found, lambda x: F.lower(x).startswith(f"{name}:")), F.lit(-1))
        return F.regexp_replace(F.substring(last, len(name) + 2, 1 << 30), r'^"(.*)"$', "$1")

    rest = F.regexp_replace(raw, operator, " ")
    phrases = F.transform(F.regexp_extract_all(rest, F.lit('"([^"]+)"'), F.lit(1)), F.trim)
    text = T.squash(F.regexp_replace(rest, '"[^"]+"', " "))
    return F.struct(text.alias("text"), phrases.alias("phrases"), value("type").alias("type"), value("in").alias("folder"), value("since").alias("since"))


def parse_list(setting: str) -> list[str]:
    """Folders, models or endpoints of a setting: one a line or parted by commas, each once, slashes at the end gone."""
    return list(dict.fromkeys(x for x in (y.strip().rstrip("/") for y in re.split(r"[\n,]", setting)) if x))


def bare(text: Column) -> Column:
    return F.regexp_replace(text, f"^{T.SPACE}|{T.SPACE}$", "")


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, frontmatter left out."""
    return F.filter(F.transform(F.split(T.strip_frontmatter(text), r"\n\s*\n"), bare), lambda p: p != "")


def paragraphs_with_intro(text: Column) -> Column:
    """``intro, blocks``: frontmatter and a first-level title apart from the paragraphs."""
    titled = lambda p: p.rlike(r"^#\s[^\n]*$")
    parts = paragraphs(text)
    intro = F.concat_ws("\n", F.nullif(F.rtrim(F.regexp_extract(text, _BLOCK, 0)), F.lit("")), F.when((F.size(parts) > 0) & titled(F.try_element_at(parts, F.lit(1))), F.try_element_at(parts, F.lit(1))))
    return F.struct(intro.alias("intro"), F.when((F.size(parts) > 0) & titled(F.try_element_at(parts, F.lit(1))), F.slice(parts, 2, F.size(parts) + 1)).otherwise(parts).alias("blocks"))


def segments(text: Column) -> Column:
    """``heading, text`` of the parts at the shallowest heading level that occurs twice; else the whole body."""
    body = T.strip_frontmatter(text)
    count = lambda n: F.size(F.regexp_extract_all(body, F.lit(rf"(?m)^#{{{n}}}\s"), F.lit(0)))
    part = lambda heading, content: F.struct(heading.alias("heading"), content.alias("text"))
    whole = F.when(bare(body) != "", F.array(part(F.lit(""), F.rtrim(body)))).otherwise(F.array().cast("array<struct<heading:string,text:string>>"))
    out = whole
    for n in range(6, 0, -1):
        pieces = F.filter(F.split(body, rf"(?m)(?=^#{{{n}}}\s)"), _starts(n))
        out = F.when(count(n) >= 2, F.transform(pieces, lambda p: part(F.trim(F.regexp_replace(F.regexp_extract(p, r"^[^\n]*", 0), r"^#{1,6}\s+", "")), F.regexp_replace(p, r"\s+$", "")))).otherwise(out)
    return out


def _starts(level: int):
    return lambda p: p.rlike(rf"^#{{{level}}}\s")


def last_reflective(text: Column) -> Column:
    """The first sentence of the last reflective paragraph; null if none."""
    return T.first_sentence(F.try_element_at(F.filter(paragraphs(text), T.is_reflective), F.lit(-1)))


def questions(text: Column, heading: str = "Questions to elaborate") -> Column:
    """The bullets under a second-level heading."""
    part = F.regexp_extract(text, rf"## {re.escape(heading)}\s*\n([\s\S]*?)(?:\n## |\z)", 1)
    return F.filter(F.transform(F.split(part, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*-\s*", ""))), lambda x: x != "")


def inert_quote(text: Column, most: int = 280) -> Column:
    """Untrusted text without working links, embeds, tags, code or comments."""
    s = T.squash(text)
    # What is disarmed, in order.
    for a, b in ((r"\[\[", "[ ["), (r"\]\]", "] ]"), (r"\]\(", "] ("), (r"!\[", "! ["), ("[`<>]", "'"), (r"(^|\s)#(?=\w)", "$1# "), ("%%", "% %")):
        s = F.regexp_replace(s, a, b)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def merged_frontmatter(kept: Column, other: Column) -> Column:
    """Two maps of frontmatter as one: the kept value wins, inline lists are united."""
    both = lambda k, a, b: F.when(a.rlike(r"^\[.*\]$") & b.rlike(r"^\[.*\]$"), F.concat(F.lit("["), F.array_join(F.array_union(_items(a), _items(b)), ", "), F.lit("]"))).otherwise(F.coalesce(a, b))
    return F.map_zip_with(kept, other, both)


def _items(value: Column) -> Column:
    inner = F.regexp_replace(F.trim(value), r"^\[(.*)\]$", "$1")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")), lambda x: x != "")


def embed_text(path: Column, title: Column, text: Column) -> Column:
    """What is embedded of a chunk: its title first, unless that says nothing."""
    dull = (F.trim(title) == "") | P.is_untitled(title) | P.looks_periodic(path)
    return F.when(F.coalesce(dull, F.lit(True)), text).otherwise(F.concat(title, F.lit("\n\n"), text))


def with_backlink(text: Column, title: str) -> Column:
    """The note with a bullet under "## Related", which is added if it isn't there; nothing twice."""
    line = f"- [[{title}]]"
    there = text.contains(line)
    under = F.regexp_replace(text, r"(?m)^## Related[ \t]*$", "## Related\n" + line.replace("$", "\\$"))
    return F.when(there, text).when(text.rlike(r"(?m)^## Related[ \t]*$"), under).otherwise(F.concat(F.rtrim(text), F.lit(f"\n\n## Related\n{line}\n")))


def normal_tag(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^#+", "")


def dated_tag(tag: Column) -> Column:
    """Tags of an old habit: a date or a year as a tag."""
    return normal_tag(tag).rlike(r"^[0-9]{4}([-/][0-9]{2}){0,2}$")


def is_empty_note(text: Column) -> Column:
    """No body, and no frontmatter but keys that say nothing."""
    body = bare(F.regexp_replace(text, _BLOCK, ""))
    said = F.filter(F.split(F.regexp_extract(text, _BLOCK, 1), "\n"), lambda x: x.rlike(r"^\s*[A-Za-z0-9_-]+\s*:\s*\S") & ~F.lower(x).rlike(r"^\s*(created|updated|modified|date|type|tags)\s*:"))
    return (body == "") & (F.size(said) == 0)


def triage(text: Column, cosine: Column, merge: float = 0.9) -> Column:
    """``archive`` what has no substance, ``merge`` what has a near twin, else ``elaborate``."""
    substance = bare(F.regexp_replace(F.regexp_replace(text, _BLOCK, ""), r"[#>*\-_`\[\]|]", ""))
    return F.when(F.length(F.coalesce(substance, F.lit(""))) < 40, "archive").when(cosine >= merge, "merge").otherwise("elaborate")


def publish_review(candidate: Column, unchanged: Column, flags: Column, affinity: Column, problems: Column) -> Column:
    """Where a note stands before publishing: any flag or a journal's company holds it back."""
    return (
        F.when(~candidate, "private").when(unchanged, "unchanged").when((F.size(flags) > 0) | (affinity >= 0.65), "hold")
        .when(F.size(problems) > 0, "polish").when(affinity >= 0.5, "unreviewed").otherwise("cleared")
    )


def continuity(before: Column, today: Column) -> Column:
    """How long ago a day is, in words."""
    days = F.datediff(today, before)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 6, F.date_format(before, "EEEE")).otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def legacy_kind(item: Column) -> Column:
    """Kind of a record of the old itinerary."""
    # The old items that are transport.
    i = F.lower(F.trim(item))
    return F.when(i.isin("flight", "train", "transfer", "rental", "bus", "ferry"), "transport").when(i == "stay", "stay").otherwise("activity")


def ghost(results, para: str, before: str, after: str, least: float):
    """The best result to offer as a link while typing, or no rows: not in a word, not in a link.

    ``results`` has ``path, title, cosine, linked, dismissed``."""
    if not para.strip() or re.match(r"\w", after or "") or re.search(r"\[\[[^\]]*$", before):
        return results.limit(0)
    fit = results.where((F.col("cosine") >= least) & ~F.col("linked") & ~F.col("dismissed"))
    return fit.orderBy(F.desc("cosine"), "path").limit(1)


def filtered(notes, folder: str | None = None, tag: str | None = None, since: str | None = None, words: str | None = None):
    """Notes of a folder, with a tag or one under it, changed since a day, with all words in their name."""
    if folder:
        notes = notes.where(P.under(F.col("path"), folder))
    if tag:
        notes = notes.where(F.exists("tags", lambda t: (F.lower(normal_tag(t)) == tag.lower()) | F.lower(normal_tag(t)).startswith(tag.lower() + "/")))
    if since:
        notes = notes.where(F.col("mtime") >= F.lit(since).cast("timestamp"))
    for w in (words or "").lower().split():
        notes = notes.where(F.lower(P.basename(F.col("path"))).contains(w))
    return notes


def validate(kind: Column, op: Column, key: Column, title: Column) -> Column:
    """What is wrong with an observation, as a list."""
    from corpusloom.operators.records import SPECS

    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.array_compact(F.array(
        F.when(blank(key), F.lit("no key")),
        F.when(~F.coalesce(kind.isin(*SPECS), F.lit(False)), F.lit("unknown kind")),
        F.when(~F.coalesce(op.isin("create", "update", "log", "digest"), F.lit(False)), F.lit("unknown op")),
        F.when((op == "create") & blank(title), F.lit("no title")),
    ))
