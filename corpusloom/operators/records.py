"""Typed records: specifications, audits, matching and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# For each kind its first state, its final states, and the tolerance of its dates in days.
SPECS = {
    "appointment": ("requested", ("attended", "cancelled"), 0),
    "trip": ("planned", ("done", "cancelled"), 1),
    "conference": ("planned", ("done", "cancelled"), 1),
    "transport": ("booked", ("done", "cancelled"), 0),
    "stay": ("booked", ("done", "cancelled"), 0),
    "activity": ("planned", ("done", "cancelled"), 0),
    "bill": ("issued", ("paid",), 5),
    "task": ("proposed", ("done", "dropped"), 3),
    "project": ("active", (), 0),
    "person": (None, (), 0),
}


def is_open(kind: Column, state: Column) -> Column:
    """Not in a final state of its kind."""
    out = F.lit(True)
    for name, (_, final, _) in SPECS.items():
        if final:
            out = out & ~((kind == name) & state.isin(*final))
    return F.coalesce(out, F.lit(True))


def tolerance(kind: Column) -> Column:
    out = F.lit(0)
    for name, (_, _, days) in SPECS.items():
        out = F.when(kind == name, days).otherwise(out)
    return out


def clean_number(text: Column) -> Column:
    """A number with or without separators, to two digits; null if it can't be read."""
    return F.round(F.regexp_replace(text, r"[,\s]", "").try_cast("double"), 2)


def clean_date(text: Column) -> Column:
    """YYYY-MM-DD with or without THH:MM, zone and seconds dropped; null if it isn't a date."""
    t = F.regexp_extract(F.trim(text), r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(T[0-9]{2}:[0-9]{2})?", 0)
    return F.when(F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")).isNotNull(), t)


def clean_list(items: Column, most: int = 30) -> Column:
    """Trimmed distinct strings in order, empty ones gone."""
    return F.slice(F.array_distinct(F.filter(F.transform(items, F.trim), lambda x: x != "")), 1, most)


def norm_ref(ref: Column) -> Column:
    return F.regexp_replace(F.upper(ref), "[^A-Z0-9]", "")


def norm_phone(phone: Column) -> Column:
    return F.right(F.regexp_replace(phone, "[^0-9]", ""), F.lit(9))


def email_domain(email: Column) -> Column:
    return F.lower(F.substring_index(email, "@", -1))


def reversed_dates(r: DataFrame) -> DataFrame:
    """Records that end before they start."""
    return r.where("end < start")


def undated(r: DataFrame) -> DataFrame:
    """Open records without a start."""
    return r.where(F.col("start").isNull() & is_open(F.col("kind"), F.col("state")))


def still_open(r: DataFrame, today: str) -> DataFrame:
    """Open records whose last day is past."""
    last = F.coalesce("end", "start")
    return r.where(is_open(F.col("kind"), F.col("state")) & (last.cast("date") < F.lit(today).cast("date")) & (F.col("state") != "changed"))


def missing_parent(r: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Records that name a parent which isn't there."""
    return r.where(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")


def outside_parent(r: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Records that start outside the days of their parent (``key, p_start, p_end``)."""
    return r.join(parents, key).where("start is not null and p_start is not null and (cast(start as date) < cast(p_start as date) or cast(start as date) > cast(coalesce(p_end, p_start) as date))")


def overlapping(r: DataFrame, within: str, longest: int) -> DataFrame:
    """``within, a, b``: pairs of records whose nights meet, end days excluded.

    Intervals are dealt into buckets of ``longest`` days, the longest one's length, so that
    two that overlap share a bucket; each pair is kept in the bucket where both are first.
    """
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    rows = r.select(within, "id", day("start").alias("lo"), day("end").alias("hi")).where("hi > lo")
    bucket = lambda c: F.floor(F.col(c) / longest)
    rows = rows.withColumn("b", F.explode(F.sequence(bucket("lo"), F.floor((F.col("hi") - 1) / longest))))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, F.expr(f"a.{within} = b.{within} and a.b = b.b and a.id < b.id and a.lo < b.hi and b.lo < a.hi and a.b = floor(greatest(a.lo, b.lo) / {longest})"))
    return met.select(F.col(f"a.{within}").alias(within), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def twice(r: DataFrame, within: str) -> DataFrame:
    """``within, day, kind, name, copies, first``: records of one kind, day and name that are there more than once."""
    return r.groupBy(within, F.col("start").cast("date").alias("day"), "kind", "name").agg(F.count("*").alias("copies"), F.min("id").alias("first")).where("copies > 1")


def names_agree(a: Column, b: Column) -> Column:
    """Equal, or one of five letters or more inside the other; null if either is empty."""
    x, y = (F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ") for c in (a, b))
    fit = (x == y) | ((F.length(x) >= 5) & y.contains(x)) | ((F.length(y) >= 5) & x.contains(y))
    return F.when((F.length(F.trim(x)) > 0) & (F.length(F.trim(y)) > 0), fit)


def date_fits(start: Column, end: Column, lo: Column, hi: Column, days: Column) -> Column:
    """Whether two ranges of days meet, the first one widened; null without a date."""
    a, b = start.cast("date"), F.coalesce(end, start).cast("date")
    c, d = lo.cast("date"), F.coalesce(hi, lo).cast("date")
    return (F.datediff(c, b) <= days) & (F.datediff(a, d) <= days)


def resolve(scored: DataFrame, by: str) -> DataFrame:
    """``by, answer, record``: from candidates ``by, record, positives, excluded, hard, conflict``.

    A hard key decides; then a single fit; a conflict or several fits ask for review.
    """
    fit = scored.where("not excluded")
    n = fit.groupBy(by).agg(
        F.count(F.when(F.col("hard"), 1)).alias("hards"), F.min(F.when(F.col("hard"), F.col("record"))).alias("hard"),
        F.count(F.when(F.col("positives") > 0, 1)).alias("fits"), F.min(F.when(F.col("positives") > 0, F.col("record"))).alias("one"),
        F.max(F.col("conflict").cast("int")).alias("conflict"),
    )
    answer = F.when(F.col("hards") == 1, "exact").when(F.col("hards") > 1, "several").when(F.col("fits") == 1, "unique").when(F.col("conflict") == 1, "conflict").when(F.col("fits") > 1, "several").otherwise("none")
    return n.select(by, answer.alias("answer"), F.when(F.col("hards") == 1, F.col("hard")).when((F.col("hards") == 0) & (F.col("fits") == 1), F.col("one")).alias("record"))


def ledger_state(events: DataFrame, key: str, at: str, seq: str) -> DataFrame:
    """The last entry of each key, by time, then sequence, with how many there were."""
    last = F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(F.col(at), F.col(seq)))
    return events.groupBy(key).agg(F.count("*").alias("entries"), last.alias("s")).select(key, "entries", "s.*")


def _day(c: Column) -> Column:
    return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))


def _minutes(c: Column) -> Column:
    """Minutes of the day of a date with a time; null for a day alone."""
    return F.when(F.length(c) > 10, F.substring(c, 12, 2).cast("int") * 60 + F.substring(c, 15, 2).cast("int"))


def assess_stay(pairs: DataFrame) -> DataFrame:
    """Adds ``positives, excluded, conflict`` to pairs of a stay (``title, start, end``) and a query (``q_name, q_date, q_end``)."""
    named = names_agree(F.col("q_name"), F.col("title"))
    lo, hi = _day(F.col("start")), F.greatest(_day(F.coalesce("end", "start")), _day(F.col("start")))
    a, b = _day(F.col("q_date")), _day(F.col("q_end"))
    nights = F.coalesce(b > a, F.lit(False))
    overlap = F.when(nights, (a < F.greatest(hi, lo + 1)) & (b > lo)).otherwise((a >= lo) & (a <= hi))
    met, good, other = F.coalesce(overlap, F.lit(False)), F.coalesce(named, F.lit(False)), F.coalesce(~named, F.lit(False))
    apart = F.coalesce(~overlap, F.lit(False))
    points = good.cast("int") + met.cast("int")
    return pairs.select(
        "*",
        F.when(apart | other, 0).when(~good & met & ~nights, 0).otherwise(points).alias("positives"),
        (apart | (other & ~(met & nights))).alias("excluded"),
        (other & met & nights & ~apart).alias("conflict"),
    )


def assess_transport(pairs: DataFrame) -> DataFrame:
    """Adds ``positives, excluded`` to pairs of a leg (``start, number, origin, target``) and a query (``q_date, q_number, q_from, q_to``).

    The day with the number or the route makes it; the day alone never does, and a time
    more than 15 minutes off counts against a route."""
    same = _day(F.col("start")) == _day(F.col("q_date"))
    number = norm_ref(F.col("number")) == norm_ref(F.col("q_number"))
    route = names_agree(F.col("origin"), F.col("q_from")) & names_agree(F.col("target"), F.col("q_to"))
    near = F.coalesce(F.abs(_minutes(F.col("start")) - _minutes(F.col("q_date"))) <= 15, F.lit(True))
    yes = F.coalesce(same & (number | (route & near)), F.lit(False))
    no = F.coalesce(~same, F.lit(False)) | F.coalesce(~number, F.lit(False)) | F.coalesce(~route, F.lit(False))
    return pairs.select("*", F.when(yes & ~no, 2).otherwise(0).alias("positives"), (no & ~yes).alias("excluded"))


def assess_activity(pairs: DataFrame) -> DataFrame:
    """Adds ``positives, excluded`` to pairs of an activity (``title, start, place``) and a query (``q_name, q_date, q_place``):
    the same day, and the name within two hours or the place within half an hour."""
    same = F.coalesce(_day(F.col("start")) == _day(F.col("q_date")), F.lit(False))
    apart = F.abs(_minutes(F.col("start")) - _minutes(F.col("q_date")))
    name = F.coalesce(names_agree(F.col("title"), F.col("q_name")), F.lit(False)) & F.coalesce(apart <= 120, F.lit(True))
    place = F.coalesce(names_agree(F.col("place"), F.col("q_place")), F.lit(False)) & F.coalesce(apart <= 30, F.lit(False))
    return pairs.select("*", F.when(same, name.cast("int") + place.cast("int")).otherwise(0).alias("positives"), (~same).alias("excluded"))


def assess_bill(pairs: DataFrame) -> DataFrame:
    """Adds ``positives, excluded`` to pairs of a bill (``payee, period, amount``) and a query (``q_payee, q_period, q_amount``)."""
    payee = names_agree(F.col("payee"), F.col("q_payee"))
    period = F.lower("period") == F.lower("q_period")
    amount = F.abs(F.col("amount") - F.col("q_amount")) < 0.005
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    no = F.coalesce(~payee, F.lit(False)) | F.coalesce(~period, F.lit(False))
    return pairs.select("*", (yes(payee) + yes(period) + yes(amount)).alias("positives"), no.alias("excluded"))


def compare_with_source(records: DataFrame, lines: DataFrame) -> DataFrame:
    """``id, gone, times_differ, amounts_differ``: records (``id, quote, start, price``) against the lines
    (``id, line``) of the note they were read from, white space and case aside."""
    from corpusloom.functions.text import amounts_in, squash, times_in

    flat = lambda c: F.lower(squash(F.col(c)))
    found = records.join(lines, "id", "left").withColumn("hit", flat("line").contains(flat("quote")))
    best = found.groupBy("id").agg(F.max_by("line", F.col("hit").cast("int")).alias("line"), F.max("hit").alias("hit"), F.first("start").alias("start"), F.first("price").alias("price"))
    times, amounts = times_in(F.col("line")), amounts_in(F.col("line"))
    at = F.when(F.length("start") > 10, F.substring("start", 12, 5))
    hit = F.coalesce("hit", F.lit(False))
    return best.select(
        "id",
        (~hit).alias("gone"),
        F.coalesce(hit & (F.size(times) > 0) & ~F.array_contains(times, at), F.lit(False)).alias("times_differ"),
        F.coalesce(hit & (F.size(amounts) > 0) & ~F.array_contains(amounts, F.col("price")), F.lit(False)).alias("amounts_differ"),
    )


def plan(observations: DataFrame) -> DataFrame:
    """Adds ``decision``: ``reject`` what has errors or a state its kind doesn't know, ``review`` what
    is unclear or was edited by hand, else ``apply``. Needs ``errors, answer, human_edited, state_ok``."""
    decision = (
        F.when((F.size("errors") > 0) | ~F.col("state_ok"), "reject")
        .when(F.col("answer").isin("several", "conflict") | F.col("human_edited"), "review")
        .otherwise("apply")
    )
    return observations.withColumn("decision", decision)
