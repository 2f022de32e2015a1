"""Personal identifiers: fixed forms, and others found by their context.

The fixed forms are the seeds. The words around them make lexical patterns; a pattern's
confidence in a kind is the share of that kind among all identifiers it stands with, an
unseen identifier's confidence that at least one of its patterns tells the truth, and
both are scored in turn over the graph of patterns and identifiers. Identifiers of a
fitting shape whose confidence is high are added. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.lineage import cut

KINDS = ("email", "ip", "card", "phone")
#: The leftmost matches of the forms asked for. Runs are possessive and start where no
#: earlier start is possible, so that no text takes more than linear time.
FORMS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text holds if it holds the form.
HINTS = ("@", None, None, "+")
#: A word with a digit or an at-sign.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Shapes that an unseen identifier of each kind may have.
SHAPES = (
    r"^[^@]+@[^@]+$",
    r"^(?=.*[.:].*[.:])[0-9A-Fa-f.:]+$",
    r"^(?=(?:[^0-9]*[0-9]){12})[0-9-]+$",
    r"^(?=(?:[^0-9]*[0-9]){7})[+0-9().-]+$",
)
#: Seeds that a pattern needs, rounds of scoring, and the confidence that adds an identifier.
SUPPORT, ROUNDS, SURE = 5, 3, 0.9
#: Matches whose places are summed together.
STEP = 256
#: Texts with added spans that may travel to the documents.
FEW = 200_000
_SPANS = "array<struct<kind:int,start:int,end:int>>"


def _luhn(m: Column) -> Column:
    d = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(d)
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, 2).otherwise(1) * F.substring(d, i, F.lit(1)).cast("int"))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return n.between(16, 19) & (total % 10 == 0)


def _valid(kind: int, m: Column) -> Column:
    if kind == 1:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == 2:
        return F.when(F.length(m) <= 37, _luhn(m)).otherwise(F.lit(False))
    if kind == 3:
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _located(text: Column, form: str, kind: int | None) -> Column:
    """Spans of the matches in order, in code points, as arrays of up to ``STEP`` spans.

    The pieces between matches are as many as the matches, plus one; lengths are summed
    within a step, then over steps, so that thousands of matches stay cheap."""
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    pairs = F.filter(F.zip_with(F.split(text, form, -1), found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m"))), lambda x: x.m.isNotNull())
    ok = (lambda x: _valid(kind, x.m)) if kind is not None else (lambda x: F.lit(True))
    none = F.array().cast(_SPANS)

    def walk(a, x):
        one = F.struct(F.lit(kind or 0).alias("kind"), (a.at + x.gap).alias("start"), (a.at + x.gap + F.length(x.m)).alias("end"))
        return F.struct((a.at + x.gap + F.length(x.m)).alias("at"), F.when(ok(x), F.concat(a.spans, F.array(one).cast(_SPANS))).otherwise(a.spans).alias("spans"))

    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.size(pairs) - 1, F.lit(0)), F.lit(STEP)), lambda i: F.aggregate(F.slice(pairs, i + 1, F.lit(STEP)), F.struct(F.lit(0).alias("at"), none.alias("spans")), walk))
    moved = lambda at, spans: F.transform(spans, lambda s: F.struct(s.kind.alias("kind"), (s.start + at).alias("start"), (s.end + at).alias("end")))
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out")),
        lambda a, c: F.struct((a.at + c.at).alias("at"), F.concat(a.out, F.array(moved(a.at, c.spans)).cast(f"array<{_SPANS}>")).alias("out")),
        lambda a: a.out,
    )


def base_spans(text: Column) -> Column:
    """Spans of the fixed forms by kind, then start; none for null."""
    none = F.array().cast(_SPANS)
    parts = []
    for kind, (form, hint) in enumerate(zip(FORMS, HINTS, strict=True)):
        there = text.contains(hint) if hint else text.rlike(r"[0-9]\.[0-9]" if kind == 1 else r"(?:[0-9][\x20-]?){15}[0-9]")
        parts.append(F.when(there, F.flatten(_located(text, form, kind))).otherwise(none))
    return F.coalesce(F.concat(*parts), none)


def _around(text: Column, s: Column) -> list[Column]:
    """The value of a span of ``text`` and its patterns: the word before, the two before,
    the words on either side."""
    left = F.split(F.concat(F.lit("^ ^ "), F.lower(F.rtrim(F.regexp_replace(F.substring(text, F.greatest(s.start - 59, F.lit(1)), F.least(s.start, F.lit(60))), "[\\x20\\x09-\\x0D]+", " ")))), " ")
    right = F.element_at(F.split(F.concat(F.lower(F.ltrim(F.regexp_replace(F.substring(text, s.end + 1, F.lit(40)), "[\\x20\\x09-\\x0D]+", " "))), F.lit(" $")), " "), 1)
    masked = lambda c: F.regexp_replace(c, "[0-9]", "0")
    one, two = masked(F.element_at(left, -1)), masked(F.element_at(left, -2))
    return [
        F.substring(text, s.start + 1, s.end - s.start).alias("value"),
        F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two, F.lit(" "), one), F.concat(F.lit("3 "), one, F.lit(" _ "), masked(right))).alias("patterns"),
    ]


def _found(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, base, tokens``: spans of fixed forms, and of other words with a digit or an at-sign."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("tokens", F.when(F.col("text").rlike("[0-9@]"), _located(F.col("text"), TOKEN, None)).otherwise(F.array().cast(f"array<{_SPANS}>")))

    def apart(step: Column) -> Column:
        near = F.filter("base", lambda b: (b.start < F.element_at(step, -1).end) & (F.element_at(step, 1).start < b.end))
        return F.filter(step, lambda t: ~F.exists(near, lambda b: (b.start < t.end) & (t.start < b.end)))

    def named(steps: Column, seed: int) -> Column:
        """The spans with their surroundings, read from the part of the text that a step covers."""
        steps = F.filter(steps, lambda step: F.size(step) > 0)
        first = lambda step: F.greatest(F.element_at(step, 1).start - 60, F.lit(0))
        parts = F.transform(steps, lambda step: F.struct(step.alias("spans"), first(step).alias("at"), F.substring(F.col("text"), first(step) + 1, F.array_max(F.transform(step, lambda s: s.end)) + 40 - first(step)).alias("text")))

        def one(part: Column, s: Column) -> Column:
            moved = F.struct((s.start - part.at).alias("start"), (s.end - part.at).alias("end"))
            return F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), F.lit(seed).alias("seed"), *_around(part.text, moved))

        return F.flatten(F.transform(parts, lambda part: F.transform(part.spans, lambda s: one(part, s))))

    based = F.transform(F.sequence(F.lit(0), F.greatest(F.size("base") - 1, F.lit(0)), F.lit(STEP)), lambda i: F.slice(F.col("base"), i + 1, F.lit(STEP)))
    free = F.transform(F.filter("tokens", lambda step: F.size(step) > 0), apart)
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "base", F.concat(named(based, 1), named(free, 0)).alias("seen"))


def added_spans(found: DataFrame) -> DataFrame:
    """``doc_id, text_hash, kind, start, end`` of the identifiers that context adds."""
    seen = found.select("doc_id", "text_hash", F.explode("seen").alias("s")).select("doc_id", "text_hash", "s.*")
    edges = seen.select("seed", F.when(F.col("seed") == 1, F.col("kind")).alias("kind"), "value", F.explode("patterns").alias("pattern")).distinct()
    # only patterns with enough different seeds of a kind can score; the others' edges go
    support = edges.where("seed = 1").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(f"seeds >= {SUPPORT}")
    totals = edges.groupBy("pattern").agg(F.countDistinct("value").alias("values"))
    score = cut(support.join(totals, "pattern").select("pattern", "kind", "seeds", "values", (F.col("seeds") / (F.col("values") + 1)).alias("conf")))
    shape = F.array_compact(F.array(*(F.when(F.col("value").rlike(p), F.lit(k)) for k, p in enumerate(SHAPES))))
    open_edges = edges.where("seed = 0").select("value", "pattern", F.explode(shape).alias("kind"))
    open_edges = cut(open_edges.join(score.select("pattern", "kind"), ["pattern", "kind"], "left_semi").select("pattern", "kind", "value").distinct())
    sure = None
    for _ in range(ROUNDS):
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf"))))
        sure = open_edges.join(score, ["pattern", "kind"]).groupBy("kind", "value").agg((1 - F.exp(doubt)).alias("sure"))
        more = open_edges.join(sure, ["kind", "value"]).groupBy("pattern", "kind").agg(F.sum("sure").alias("more"))
        conf = F.least(F.lit(1.0), (F.col("seeds") + F.coalesce("more", F.lit(0.0))) / (F.col("values") + 1))
        score = cut(score.drop("conf").join(more, ["pattern", "kind"], "left").select("pattern", "kind", "seeds", "values", conf.alias("conf")))
    # patterns must be sure themselves; many weak ones don't add up
    strong = open_edges.join(score.where(f"conf >= {SURE}"), ["pattern", "kind"]).groupBy("kind", "value").agg(F.max("conf").alias("conf"))
    best = strong.join(sure.where(f"sure >= {SURE}"), ["kind", "value"]).groupBy("value").agg(F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind"))
    return seen.where("seed = 0").drop("kind").join(best, "value").select("doc_id", "text_hash", "kind", "start", "end").distinct()


def _with_added(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the documents hold, and the added spans by text."""
    found = cut(_found(docs))
    more = cut(added_spans(found).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "end")).cast(_SPANS).alias("more")))
    return found, F.broadcast(more) if more.count() <= FEW else more


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kind, s.kind + 1), F.lit(":"), s.start.cast("string"), F.lit(":"), s.end.cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` for each row.

    The counts and the hash are of the fixed forms, ``spans`` has those and the added
    ones. Null texts count as empty: no spans. Rows keep a null or repeated doc_id, and
    repeated rows are treated alike; an empty table gives an empty result.
    """
    found, more = _with_added(docs)
    rows = found.select("doc_id", "text_hash", "base").alias("f").join(more.alias("m"), F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.text_hash") == F.col("m.text_hash")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPANS))))
    of = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select(F.col("f.doc_id").alias("doc_id"), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.when(F.col("more").isNull(), 0).otherwise(F.size("more")).cast("long").alias("n_added"))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every identifier in ``text`` replaced by its kind in angle brackets;
    overlapping ones become one, of the kind that starts first. Columns as they were."""
    _, more = _with_added(docs)
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("t"), F.col("doc_id").cast("long").alias("d"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("t", F.lit("")))).join(more, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left")
    spans = F.concat(base_spans(F.coalesce("t", F.lit(""))), F.coalesce("more", F.array().cast(_SPANS)))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    state = F.aggregate(
        F.col("order"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(F.greatest(a.at, s.end).alias("at"), F.when(s.start >= a.at, F.concat(a.out, F.array(F.substring(F.col("t"), a.at + 1, s.start - a.at), F.element_at(names, s.kind + 1)))).otherwise(a.out).alias("out")),
        lambda a: F.concat(F.array_join(a.out, ""), F.substring(F.col("t"), a.at + 1, F.length("t"))),
    )
    rows = rows.withColumn("order", order)
    masked = F.when(F.size("order") > 0, state).otherwise(F.col("t"))
    return rows.select(*(masked.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
