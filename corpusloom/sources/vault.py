"""Markdown vaults: reading notes, their frontmatter and links, and sorting files by kind."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import predicates as P
from corpusloom.functions import text as T

_BLOCK = r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)"


def frontmatter(text: Column) -> Column:
    """Key lines of the leading block as a map; no block, no keys.

    An inline list stays as written, and a list with an item a line, under a key without a
    value, reads as one. A repeated key counts as its last value. Other lines are passed
    over, so a malformed block never fails."""
    block = F.regexp_extract(text, _BLOCK, 1)
    # items under a key go to the key's line
    inline = F.regexp_replace(F.regexp_replace(block, r"\r\n", "\n"), r"(?m)^([A-Za-z_][\w -]*:)[ \t]*\n(?=[ \t]*-[ \t])", "$1 \u0001")
    inline = F.regexp_replace(inline, r"\n[ \t]*-[ \t]+", "\u0001")
    lines = F.filter(F.split(inline, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w -]*:"))
    items = lambda v: F.filter(F.transform(F.split(v, "\u0001"), lambda i: F.trim(F.regexp_replace(i, r"^[ \t]*-[ \t]+", ""))), lambda i: i != "")
    plain = lambda v: F.regexp_replace(F.trim(v), r"^[\"'](.*)[\"']$", "$1")
    value = lambda x: F.regexp_replace(x, r"^[^:]*:", "")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.when(value(x).contains("\u0001"), F.concat(F.lit("["), F.array_join(items(value(x)), ", "), F.lit("]"))).otherwise(plain(value(x))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda q: q.k == p.k))
    return F.map_from_entries(last)


def listed(value: Column) -> Column:
    """The items of an inline list, or a single value as a list."""
    inner = F.regexp_replace(F.trim(value), r"^\[(.*)\]$", "$1")
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^[\"'#]+|[\"']+$", ""))
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def searchable_meta(fm: Column) -> Column:
    """Aliases, tags and title of the frontmatter as one text."""
    keys = ("aliases", "alias", "tags", "tag", "title")
    return F.array_join(F.flatten(F.array(*(listed(F.coalesce(fm[k], F.lit(""))) for k in keys))), " ")


def scan_vault(spark: SparkSession, root: str, folders: list[str] | None = None, patterns: tuple[str, ...] = ()) -> DataFrame:
    """``path, title, folder, mtime, content, fm, link_count`` of all notes under a folder.

    Excluded folders and patterns, and anything under a dotted folder, are as if absent."""
    raw = spark.read.text(re.sub(r"([\[\]{}*?])", r"\\\1", root), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    base = "/" + root.rstrip("/").split(":", 1)[-1].strip("/") + "/"
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.substring(full, F.instr(full, base) + len(base), F.length(full))
    rows = raw.select(path.alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("content"))
    rows = rows.where(~P.excluded(F.col("path"), folders or [], patterns) & ~F.col("path").rlike(r"(^|/)\."))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    links = F.size(F.regexp_extract_all("content", F.lit(r"!?\[\[[^\]]+\]\]"), F.lit(0)))
    return rows.select("path", P.basename(F.col("path")).alias("title"), folder.alias("folder"), "mtime", "content", frontmatter(F.col("content")).alias("fm"), links.alias("link_count"))


def resolve_links(notes: DataFrame) -> DataFrame:
    """``src, dst, n, resolved``: links of all notes; a name means the first note of that name in
    any case, a path the note itself; links to oneself go."""
    raw = notes.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(r"\[\[([^\]|#]+)"), F.lit(1))).alias("t")).groupBy("src", F.trim("t").alias("t")).agg(F.count("*").alias("n"))
    names = notes.groupBy(F.lower(P.basename(F.col("path"))).alias("key")).agg(F.min("path").alias("by_name"))
    paths = notes.select(F.lower(F.regexp_replace("path", r"(?i)\.md$", "")).alias("full"), F.col("path").alias("by_path"))
    key = F.lower(F.regexp_replace("t", r"(?i)\.md$", ""))
    found = raw.withColumn("key", F.substring_index(key, "/", -1)).withColumn("full", F.when(F.col("t").contains("/"), key)).join(names, "key", "left").join(paths, "full", "left")
    dst = F.coalesce("by_path", "by_name")
    return found.select("src", F.coalesce(dst, F.col("t")).alias("dst"), "n", dst.isNotNull().alias("resolved")).where("src <> dst")


def sniff(content: Column) -> Column:
    """Kind of a file by its first bytes; null if none is known."""
    # The signatures of the kinds.
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("504B0304"), "pkpass")


def transcripts(turns: DataFrame) -> DataFrame:
    """``conv_id, title, note``: each conversation as one markdown note, turns in order."""
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    body = F.array_join(F.transform("said", lambda s: F.concat(F.lit("**"), s.role, F.lit(":** "), s.text)), "\n\n")
    rows = turns.groupBy("conv_id").agg(said.alias("said"))
    return rows.select("conv_id", T.first_sentence(F.col("said")[0]["text"], 60).alias("title"), body.alias("note"))
