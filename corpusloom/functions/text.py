"""Text functions: Columns to Columns, nothing row by row in Python.

Lengths are code points. White space is the ASCII set unless a pattern says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"
WORD = r"[\p{L}\p{N}']{3,}"
# Words that context terms and word keys leave out.
CONTEXT_STOP = (
    "the and are was were has had have its this that with for not but you your they them their "
    "then than there here what when where which who how why can could would should will just about "
    "into over from been being because also only some more most very much many like one two all any"
).split()
KEY_STOP = "the and are was has had its this that".split()
TERM_CAP = 16


def squash(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clip(text: Column, most: int, least_word: int = 0) -> Column:
    """At most ``most`` characters, cut at the last space past ``least_word`` if there is one."""
    head = F.substring(text, 1, most + 1)
    at = most + 1 - F.length(F.substring_index(head, " ", -1)) - 1  # characters before the last space
    cut = F.when((F.instr(head, " ") > 0) & (at > least_word), F.substring(text, F.lit(1), at)).otherwise(F.substring(text, 1, most))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def snippet(text: Column, most: int = 160) -> Column:
    """The text on one line, with an ellipsis past ``most`` characters."""
    flat = squash(text)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def snippet_around(text: Column, term: str, before: int = 100, width: int = 260) -> Column:
    """A window of the text on one line that starts a little before the first use of a term,
    with an ellipsis where it is cut."""
    flat = F.regexp_replace(text, SPACE, " ")
    at = F.greatest(F.instr(F.lower(flat), term.lower()) - 1 - before, F.lit(0))
    return F.concat(F.when(at > 0, "…").otherwise(""), F.trim(F.substring(flat, at + 1, F.lit(width))), F.when(F.length(flat) > at + width, "…").otherwise(""))


def context_terms(text: Column) -> Column:
    """The longest distinct words of a paragraph, first come first among equals, at most 16."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    kept = F.array_except(found, F.array(*map(F.lit, CONTEXT_STOP)))
    placed = F.transform(kept, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.array_join(F.transform(F.slice(F.array_sort(placed), 1, TERM_CAP), lambda s: s.w), " ")


def word_set(text: Column) -> Column:
    """The sorted distinct words of a paragraph without a few of the commonest."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, KEY_STOP))))


def word_key(path: Column, text: Column) -> Column:
    """A key that survives small edits: the path and the word set, or the start of a wordless text."""
    words, bare = word_set(text), F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")
    return F.concat(path, F.lit("::"), F.when((F.size(words) == 0) & (F.length(bare) > 0), F.substring(bare, 1, 60)).otherwise(F.array_join(words, ",")))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word sets: 1 if equal, else 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def strip_frontmatter(text: Column) -> Column:
    """The text without a leading block of key lines between rules."""
    block = F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)", 1)
    return F.when(block.rlike(r"(?m)^[A-Za-z_][\w -]*:"), F.regexp_replace(text, r"^---\r?\n[\s\S]*?\r?\n---(?:\r?\n|$)", "")).otherwise(text)


def sanitize_title(title: Column) -> Column:
    """A title that may name a file."""
    clean = squash(F.regexp_replace(title, r'[\\/:*?"<>|#^\[\]]', " "))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("Untitled"))


def title_from_content(text: Column) -> Column:
    """The first line that can be a title, of at most 60 characters, cut between words; null if none."""
    lines = F.transform(F.split(strip_frontmatter(text), r"\r?\n"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, "[\\t\\r]", " ")), r"^#{1,6}\s+", ""))
    plain = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"), r"\[\[([^\]]+)\]\]", "$1"), r"[*_`>#]", ""))
    named = F.transform(F.filter(plain, lambda x: F.length(squash(x)) > 0), lambda x: sanitize_title(x))
    good = F.filter(named, lambda x: (F.length(x) >= 3) & ~F.lower(x).rlike(r"^untitled( \d+)?$"))
    return clip(F.try_element_at(good, F.lit(1)), 60, 20)


def first_sentence(text: Column, most: int = 110) -> Column:
    """The first sentence on one line, clipped between words with an ellipsis."""
    flat = squash(text)
    one = F.coalesce(F.nullif(F.regexp_extract(F.concat(flat, F.lit(" ")), r"^(.*?[.!?…。！？])\s", 1), F.lit("")), flat)
    return F.when(F.length(one) > most, F.concat(clip(one, most - 1, 30), F.lit("…"))).otherwise(one)


def html_plain(html: Column) -> Column:
    """Text of a page: tags gone, four entities read, white space collapsed."""
    out = F.regexp_replace(html, r"<[^>]+>", "")
    # The entities that are read, in this order.
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&#39;", "'"), ("&#039;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squash(out)


def wikilinks(text: Column) -> Column:
    """Targets of double-bracket links, without alias, fragment and folders."""
    raw = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)[^\]]*\]\]"), F.lit(1))
    return F.transform(raw, lambda x: F.trim(F.substring_index(x, "/", -1)))


def repoint_links(text: Column, old: str, new: str) -> Column:
    """Links to one target rewritten to another, alias and fragment kept."""
    import re

    return F.regexp_replace(text, r"\[\[" + re.escape(old) + r"(?=[\]|#])", "[[" + new.replace("\\", "\\\\").replace("$", "\\$"))


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over the characters of an ASCII text, as a BIGINT."""
    # Offset basis and prime of the published hash.
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.ascii(F.substring(text, i, F.lit(1))))
    codes = F.when(F.length(text) > 0, codes).otherwise(F.array().cast("array<int>"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c.cast("long")) * F.lit(16777619), F.lit(4294967296)))


def times_in(text: Column) -> Column:
    """All clock times of a text as sorted distinct HH:MM."""
    low = F.lower(text)
    exact = F.regexp_extract_all(low, F.lit(r"(?:^|[^a-z0-9_])([0-9]{1,2}[:.][0-9]{2}\s*(?:am|pm)?)(?![a-z0-9_])"), F.lit(1))
    loose = F.regexp_extract_all(low, F.lit(r"(?:^|[^a-z0-9_:.])([0-9]{1,2}\s*(?:am|pm))(?![a-z0-9_])"), F.lit(1))

    def read(x: Column) -> Column:
        hour, minute = F.regexp_extract(x, "^([0-9]+)", 1).cast("int"), F.coalesce(F.nullif(F.regexp_extract(x, "[:.]([0-9]{2})", 1), F.lit("")), F.lit("0")).cast("int")
        hour = F.when(x.endswith("pm") & (hour < 12), hour + 12).when(x.endswith("am") & (hour == 12), 0).otherwise(hour)
        return F.when(hour.between(0, 23) & minute.between(0, 59), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0")))

    named = F.array(F.when(low.rlike(r"(^|[^a-z])(noon|midday)([^a-z]|$)"), F.lit("12:00")), F.when(low.rlike(r"(^|[^a-z])midnight([^a-z]|$)"), F.lit("00:00")))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform(F.concat(exact, loose), read), named))))


def amounts_in(text: Column) -> Column:
    """All amounts of money of a text, and the sums it writes out, sorted and distinct."""
    number = lambda x: F.regexp_replace(x, ",", "").try_cast("double")
    signed = F.regexp_extract_all(text, F.lit(r"[£$€]\s?([0-9][0-9,]*(?:\.[0-9]{1,2})?)"), F.lit(1))
    named = F.regexp_extract_all(F.lower(text), F.lit(r"(?:^|[^a-z0-9_])([0-9][0-9,]*(?:\.[0-9]{1,2})?)\s?(?:gbp|usd|eur|pounds?|dollars?|euros?)(?![a-z0-9_])"), F.lit(1))
    sums = F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z0-9_])([0-9]{1,5}(?:\.[0-9]{1,2})?\s*\+\s*[0-9]{1,5}(?:\.[0-9]{1,2})?)(?![A-Za-z0-9_])"), F.lit(1))
    parts = F.transform(sums, lambda x: F.transform(F.split(x, r"\+"), lambda p: F.trim(p).try_cast("double")))
    summed = F.flatten(F.transform(parts, lambda p: F.array(p[0], p[1], F.round(p[0] + p[1], 2))))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform(F.concat(signed, named), number), summed))))


def is_log_line(line: Column) -> Column:
    """Bullets, numbered items, headings and tasks."""
    return line.rlike(r"^\s*([-*+]\s|[0-9]+[.)]\s|#{1,6}\s|\[.\]\s|- \[.\])")


def is_reflective(paragraph: Column) -> Column:
    """Prose of 100 characters or more that is not mostly log lines and has a sentence's end."""
    bare = F.regexp_replace(paragraph, f"^{SPACE}|{SPACE}$", "")
    lines = F.filter(F.split(bare, "\n"), lambda x: F.length(F.trim(x)) > 0)
    logs = F.size(F.filter(lines, is_log_line))
    return (F.length(bare) >= 100) & (logs * 2 <= F.size(lines)) & bare.rlike("[.!?…。！？]")


def word_count(text: Column) -> Column:
    """Runs between white space."""
    flat = squash(text)
    return F.when(F.length(flat) > 0, F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).otherwise(0)
