"""Deterministic rules over names, paths and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip_frontmatter, word_count

# Month names, and the shapes of dated names.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
PERIODIC = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([^A-Za-z0-9]|_|$)",
    r"^[0-9]{2}[-.][0-9]{2}[-.][0-9]{4}$",
    rf"^({MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}$",
    rf"^[0-9]{{1,2}} ({MONTHS}) [0-9]{{4}}$",
    r"^[0-9]{4}-w[0-9]{1,2}([^a-z0-9]|_|$)",
    r"^[0-9]{4}-[0-9]{2}$",
    r"^[0-9]{4}-q[1-4]$",
    r"^[0-9]{4}$",
)
# Nets for personal content, in order, with what they flag.
PERSONAL = (
    (r"my (wife|husband|partner|girlfriend|boyfriend|ex|mom|mother|dad|father|sister|brother|son|daughter|boss|manager|coworker|colleague|therapist|doctor|friend)", "mentions people close to you"),
    (r"i (feel|felt|cried|hate|love|miss|regret|resent|fear)|i'?m (afraid|scared|ashamed|angry|anxious|depressed|exhausted|lonely|heartbroken)", "first-person emotional content"),
    (r"sex|sexual|intimacy|intimate|libido|affair", "intimate content"),
    (r"therapy|therapist|medication|diagnos[a-z0-9_]+|depression|anxiety|panic attack|insomnia|illness", "health content"),
    (r"salary|my debt|net worth|mortgage|my savings", "personal finances"),
    (r"password|api[ _-]?key|secret key|ssn|social security", "credential-like content"),
)
# What a text holds if it holds a match of each net.
_HINTS = (
    ("my ",),
    ("i feel", "i felt", "i cried", "i hate", "i love", "i miss", "i regret", "i resent", "i fear", "i'm ", "im "),
    ("sex", "intima", "libido", "affair"),
    ("therap", "medication", "diagnos", "depression", "anxiety", "panic attack", "insomnia", "illness"),
    ("salary", "my debt", "net worth", "mortgage", "my savings"),
    ("password", "api", "secret key", "ssn", "social security"),
)
# File extensions of attachments.
ATTACHMENTS = "png jpg jpeg gif webp svg bmp avif heic pdf mp4 mov webm mkv m4v mp3 wav m4a ogg flac aac".split()


def basename(path: Column) -> Column:
    return F.trim(F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.md$", ""))


def looks_periodic(path: Column) -> Column:
    """Whether the name of a note is a day, week, month, quarter or year."""
    base = F.lower(basename(path))
    out = F.lit(False)
    for shape in PERIODIC:
        out = out | base.rlike(shape)
    return out


def day_key(path: Column) -> Column:
    """MM-dd of a dated name; null for others."""
    base = basename(path)
    iso = F.regexp_extract(base, r"^[0-9]{4}-([0-9]{2}-[0-9]{2})([^A-Za-z0-9]|_|$)", 1)
    month = lambda name: F.lpad(F.array_position(F.array(*map(F.lit, MONTHS.split("|"))), F.lower(name)).cast("string"), 2, "0")
    written = rf"(?i)^({MONTHS}) ([0-9]{{1,2}}), [0-9]{{4}}$"
    day_first = rf"(?i)^([0-9]{{1,2}}) ({MONTHS}) [0-9]{{4}}$"
    return (
        F.when(iso != "", iso)
        .when(base.rlike(written), F.concat(month(F.regexp_extract(base, written, 1)), F.lit("-"), F.lpad(F.regexp_extract(base, written, 2), 2, "0")))
        .when(base.rlike(day_first), F.concat(month(F.regexp_extract(base, day_first, 2)), F.lit("-"), F.lpad(F.regexp_extract(base, day_first, 1), 2, "0")))
    )


def date_style(name: Column) -> Column:
    """Which of four styles a dated name has; null for others."""
    base = basename(name)
    return (
        F.when(base.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} \S"), "iso-weekday")
        .when(base.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "iso")
        .when(base.rlike(rf"(?i)^({MONTHS}) [0-9]{{1,2}}, [0-9]{{4}}$"), "written")
        .when(base.rlike(rf"(?i)^[0-9]{{1,2}} ({MONTHS}) [0-9]{{4}}$"), "day-first")
    )


def date_name(at: Column, style: str) -> Column:
    """A day's name in a style."""
    iso = F.date_format(at, "yyyy-MM-dd")
    return {
        "iso": iso,
        "iso-weekday": F.concat_ws(" ", iso, F.date_format(at, "EEEE")),
        "written": F.date_format(at, "MMMM d, yyyy"),
        "day-first": F.date_format(at, "d MMMM yyyy"),
    }[style]


def under(path: Column, folder: str) -> Column:
    """The folder itself or anything in it."""
    return (path == folder) | path.startswith(folder + "/")


def excluded(path: Column, folders: list[str], patterns: tuple[str, ...] = ()) -> Column:
    out = F.lit(False)
    for f in folders:
        out = out | under(path, f)
    for p in patterns:
        out = out | path.rlike(p)
    return out


def passes(folder: Column, kind: Column, when: Column, in_folder: str | None = None, of_type: str | None = None, since: str | None = None) -> Column:
    """Query filters: folder as a part of the name in any case, type exactly, date from a day on.

    A date that can't be read filters nothing."""
    out = F.lit(True)
    if in_folder:
        out = out & F.lower(folder).contains(in_folder.lower())
    if of_type:
        out = out & F.coalesce(kind == of_type, F.lit(False))
    if since:
        day = F.try_to_timestamp(F.lit(since))
        out = out & F.coalesce(when >= day, day.isNull(), F.lit(False))
    return out


def passes_each(folder: Column, kind: Column, when: Column, in_folder: Column, of_type: Column, since: Column) -> Column:
    """The same with a query's filters in columns; a null filter lets all pass."""
    day = F.try_to_timestamp(since)
    inside = in_folder.isNull() | F.coalesce(F.lower(folder).contains(F.lower(in_folder)), F.lit(False))
    return inside & (of_type.isNull() | F.coalesce(kind == of_type, F.lit(False))) & (day.isNull() | F.coalesce(when >= day, F.lit(False)))


def personal_flags(text: Column) -> Column:
    """What kinds of personal content a text shows, its frontmatter aside, in fixed order."""
    low = F.lower(strip_frontmatter(text))

    def hit(net: str, hints: tuple[str, ...]) -> Column:
        some = F.lit(False)
        for h in hints:  # a plain search is far cheaper than the pattern
            some = some | low.contains(h)
        return some & low.rlike(rf"(^|[^a-z0-9_])({net})([^a-z0-9_]|$)")

    return F.array_compact(F.array(*(F.when(hit(net, hints), F.lit(flag)) for (net, flag), hints in zip(PERSONAL, _HINTS, strict=True))))


def open_tasks(text: Column) -> Column:
    return text.rlike(r"(?m)^\s*- \[ \]") | text.rlike(r"(^|[^A-Za-z0-9_])TODO([^A-Za-z0-9_]|$)")


def incompleteness(text: Column, unresolved: Column) -> Column:
    """Points for stubs, short texts, open tasks, unresolved links and empty sections."""
    n = word_count(text)
    empty = text.rlike(r"(?m)^#{1,6}[^\n]*\n(?:\s*\n)*(?=#{1,6}[ \t]|\s*\z)")
    return F.when(n < 40, 3).when(n < 120, 1).otherwise(0) + open_tasks(text).cast("int") + (unresolved > 0).cast("int") + empty.cast("int")


def polish_problems(text: Column, private: Column, unresolved: Column) -> Column:
    """What stands against publishing: links into private notes, unresolved links, tasks, stubs."""
    listed = F.concat(F.lit("links into unpublished notes: "), F.array_join(F.slice(private, 1, 3), ", "), F.when(F.size(private) > 3, "…").otherwise(""))
    return F.array_compact(F.array(
        F.when(F.size(private) > 0, listed),
        F.when(unresolved > 0, F.concat(unresolved.cast("string"), F.lit(" unresolved link(s)"))),
        F.when(open_tasks(text), F.lit("open tasks / TODO markers")),
        F.when(word_count(text) < 40, F.lit("stub — under 40 words")),
    ))


def privacy_level(path: Column, sealed: list[str], local: list[str]) -> Column:
    """Rank of a path: 2 sealed, 1 local, 0 shareable; the strictest folder counts."""
    return F.when(excluded(path, sealed), 2).when(excluded(path, local), 1).otherwise(0)


def allowed(level: Column, client: str) -> Column:
    """What a client may see: sealed nothing, local notes for local clients alone."""
    return (level == 0) | ((level == 1) & F.lit(client == "local"))


def is_attachment(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin(ATTACHMENTS) & path.contains(".")


def is_untitled(path: Column) -> Column:
    return F.lower(basename(path)).rlike(r"^untitled( [0-9]+)?$")
