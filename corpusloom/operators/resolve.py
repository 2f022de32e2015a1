"""Which record an observation means, by elimination in stages.

First what is hard: an equal reference or thread. Of the legs of one booking the service and the day
decide. Then the facts of each kind: a record that fits and isn't excluded, alone, is meant;
several, or a conflict, are for the user to tell apart. Records are found by equal
keys of the facts (days, services, words, counterparts, runs of letters), not by comparing
all of a kind, and the rules then decide on the pairs. Records without a key that is asked for go
before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.overlap import counterpart_keys, plain_name
from corpusloom.operators.records import _day, _minutes, clean_date, is_open, norm_ref, tolerance
from corpusloom.operators.spread import sieved, split_join
from corpusloom.sources.lineage import cut

RECORDS = "id long, kind string, state string, title string, refs array<string>, threads array<string>, not_threads array<string>, start string, end string, place string, counterparts array<string>, fields map<string,string>"
QUERIES = "q long, kind string, thread string, refs array<string>, name string, date string, end string, place string, counterparts array<string>, number string, from string, to string, payee string, period string, amount double, include_closed boolean"
#: Candidates that are shown for a question.
SHOWN = 6
#: Letters of the runs that names are found by, and of the shortest name that may lie in another.
RUN = 4
#: Minutes of a slot that times of a day are found by: one more than times of one journey may be apart.
SLOT = 16
# Words that don't tell places, or titles, apart.
PLACE_STOP = "the and of at in st street city airport".split()
TITLE_STOP = (
    "the and with for from your our you reservation booking booked confirmation confirmed appointment ticket tickets "
    "visit hotel hostel inn airbnb apartment apartments guesthouse lodge suites room stay check"
).split()


def _tokens(text: Column, stop: list[str]) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, stop)))


def _f(name: str) -> Column:
    return F.coalesce(F.col("fields")[name], F.lit(""))


def _said(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def _none() -> Column:
    return F.array().cast("array<string>")


def _name(text: Column, stop: list[str]) -> Column:
    """What names are compared by: ``said, plain, words``."""
    return F.struct(_said(text).alias("said"), plain_name(F.coalesce(text, F.lit(""))).alias("plain"), _tokens(text, stop).alias("words"))


def _service(text: Column) -> Column:
    """``ref, digits, letters`` of a service number."""
    ref = norm_ref(F.coalesce(text, F.lit("")))
    return F.struct(ref.alias("ref"), F.regexp_replace(ref, "^[A-Z]*0*", "").alias("digits"), F.regexp_extract(ref, "^[A-Z]*", 0).alias("letters"))


def _counterparts(items: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.filter(F.coalesce(items, _none()), lambda x: F.trim(x) != ""), counterpart_keys)))


def names_match(a: Column, b: Column) -> Column:
    """Equal but for punctuation, or one of four letters or more inside the other; false if either is empty."""
    x, y = a["plain"], b["plain"]
    return (x != "") & (y != "") & ((x == y) | ((F.length(x) >= RUN) & y.contains(x)) | ((F.length(y) >= RUN) & x.contains(y)))


def titles_agree(a: Column, b: Column) -> Column:
    """Whether every telling word of the shorter title is in the longer one; null if either has none."""
    x, y = a["words"], b["words"]
    every = F.when(F.size(x) <= F.size(y), F.size(F.array_except(x, y)) == 0).otherwise(F.size(F.array_except(y, x)) == 0)
    return F.when(a["said"] & b["said"], F.when(names_match(a, b), True).when((F.size(x) > 0) & (F.size(y) > 0), every))


def places_overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a["words"], b["words"]), F.lit(False))


def same_service(a: Column, b: Column) -> Column:
    """Equal numbers, and equal letters where both have some; null without either."""
    numbers = a["digits"].rlike("^[0-9]+$") & (a["digits"] == b["digits"])
    letters = (a["letters"] == "") | (b["letters"] == "") | (a["letters"] == b["letters"])
    return F.when((a["ref"] != "") & (b["ref"] != ""), (a["ref"] == b["ref"]) | (numbers & letters))


def route_fit(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """The same way (true), the way back (false), or neither (null)."""
    told = a_from["said"] & a_to["said"] & b_from["said"] & b_to["said"]
    way = places_overlap(a_from, b_from) & places_overlap(a_to, b_to)
    back = places_overlap(a_from, b_to) & places_overlap(a_to, b_from)
    return F.when(told, F.when(way, True).when(back, False))


def read_records(records: DataFrame) -> DataFrame:
    """Records with all that they are compared by, read once for each."""
    kind, start, end, due = F.col("kind"), clean_date(F.col("start")), clean_date(F.col("end")), clean_date(F.col("fields")["due"])
    general = F.concat_ws(" ", "place", F.col("fields")["destination"], F.col("fields")["city"], F.col("fields")["venue"])
    here = F.when(kind == "activity", F.concat_ws(" ", "place", F.col("fields")["address"], F.col("fields")["provider"])).otherwise(general)
    title = F.coalesce("title", F.lit(""))
    name = F.when(kind == "bill", _f("payee")).when(kind == "stay", F.concat_ws(" ", title, _f("lodging"))).otherwise(title)
    contacts = F.when(kind == "activity", F.filter(F.array(_f("email"), _f("contact")), lambda x: x != "")).otherwise(_none())
    return records.where("id is not null and kind is not null").select(
        "id", "kind", "state", "refs", "threads", F.coalesce("not_threads", _none()).alias("not_threads"),
        _day(start).alias("r_day"), _day(F.coalesce(end, start)).alias("r_last"), _day(F.coalesce(start, due)).alias("r_anchor"), _day(F.coalesce(end, start, due)).alias("r_until"), _minutes(start).alias("r_min"),
        _service(_f("number")).alias("r_number"), _name(_f("from"), PLACE_STOP).alias("r_from"), _name(_f("to"), PLACE_STOP).alias("r_to"), _name(here, PLACE_STOP).alias("r_place"), _name(name, TITLE_STOP).alias("r_name"),
        _counterparts(F.concat(F.coalesce("counterparts", _none()), contacts)).alias("r_people"), F.lower(_f("period")).alias("r_period"), _f("amount").try_cast("double").alias("r_amount"),
    )


def read_queries(queries: DataFrame) -> DataFrame:
    """The same of queries."""
    date, end = clean_date(F.col("date")), clean_date(F.col("end"))
    name = F.when(F.col("kind") == "bill", F.col("payee")).otherwise(F.col("name"))
    return queries.where("q is not null").select(
        "q", F.col("kind").alias("q_kind"), F.trim(F.coalesce("thread", F.lit(""))).alias("thread"), F.col("refs").alias("q_refs"), F.coalesce("include_closed", F.lit(False)).alias("include_closed"),
        _day(date).alias("q_day"), _day(end).alias("q_end"), _minutes(date).alias("q_min"),
        _service(F.col("number")).alias("q_number"), _name(F.col("from"), PLACE_STOP).alias("q_from"), _name(F.col("to"), PLACE_STOP).alias("q_to"), _name(F.col("place"), PLACE_STOP).alias("q_place"), _name(name, TITLE_STOP).alias("q_name"),
        _counterparts(F.col("counterparts")).alias("q_people"), F.lower(F.trim(F.coalesce("period", F.lit("")))).alias("q_period"), F.col("amount").alias("q_amount"),
    )


def _runs(plain: Column) -> Column:
    """Runs of letters of a name; a shorter name is a run itself."""
    return F.when(F.length(plain) >= RUN, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(plain) - (RUN - 1)), lambda k: F.substring(plain, k, F.lit(RUN))))).when(plain != "", F.array(plain)).otherwise(_none())


def _days(lo: Column, hi: Column) -> Column:
    return F.when(lo.isNotNull(), F.transform(F.sequence(lo, F.greatest(lo, F.coalesce(hi, lo))), lambda d: F.concat(F.lit("day "), d.cast("string")))).otherwise(_none())


def _prefixed(name: str, items: Column) -> Column:
    return F.transform(F.coalesce(items, _none()), lambda x: F.concat(F.lit(name), x))


def candidates(records: DataFrame, queries: DataFrame) -> DataFrame:
    """``q, id``: pairs of ``read_records`` and ``read_queries`` of one kind that share a fact; all others have nothing that speaks for them.

    For a journey a day speaks only with a service or a time, and excludes what isn't of that day."""
    tol, cents = tolerance(F.col("kind")), lambda c: F.round(c * 100).cast("long")
    one = lambda name, c: F.when(c != "", F.array(F.concat(F.lit(name), c))).otherwise(_none())
    near = F.when(F.col("r_amount").isNotNull(), F.transform(F.array(*(cents(F.col("r_amount")) + k for k in (-1, 0, 1))), lambda x: F.concat(F.lit("amount "), x.cast("string")))).otherwise(_none())

    def facts(side: str) -> list[Column]:
        c = lambda name: F.col(f"{side}_{name}")
        places = F.array_union(F.array_union(c("from")["words"], c("to")["words"]), c("place")["words"])
        return [_prefixed("place ", places), _prefixed("word ", c("name")["words"]), _prefixed("who ", c("people")), one("period ", c("period"))]

    def service(side: str) -> Column:
        number = F.col(f"{side}_number")
        return F.coalesce(F.nullif(number["digits"], F.lit("")), number["ref"])

    def at(side: str, minutes: list[Column]) -> Column:
        slots = F.array_distinct(F.array(*(F.floor(m / SLOT) for m in minutes)))
        return F.when(F.col(f"{side}_day").isNotNull() & minutes[0].isNotNull(), F.transform(slots, lambda s: F.concat_ws(" ", F.lit("time"), F.col(f"{side}_day"), s))).otherwise(_none())

    r_days = F.when(F.col("kind") == "transport", at("r", [F.col("r_min")])).otherwise(_days(F.col("r_anchor") - tol, F.greatest("r_anchor", "r_until") + tol))
    q_days = F.when(F.col("q_kind") == "transport", at("q", [F.col("q_min") + k for k in (-15, 0, 15)])).otherwise(_days(F.col("q_day"), F.col("q_end")))
    on = lambda c, day: F.concat(F.lit("number "), c, F.lit(" on "), day)
    r_service, q_service = service("r"), service("q")
    r_numbers = F.when(r_service != "", F.array(F.concat(F.lit("number "), r_service), on(r_service, F.coalesce(F.col("r_day").cast("string"), F.lit("any day"))))).otherwise(_none())
    dated = F.array(on(q_service, F.col("q_day").cast("string")), on(q_service, F.lit("any day")))
    q_numbers = F.when(q_service != "", F.when((F.col("q_kind") == "transport") & F.col("q_day").isNotNull(), dated).otherwise(F.array(F.concat(F.lit("number "), q_service)))).otherwise(_none())
    rows = records.select("id", "kind", F.col("r_name.plain").alias("plain"), F.concat(r_days, near, r_numbers, *facts("r")).alias("keys"))
    amount = F.when(F.col("q_amount").isNotNull(), F.array(F.concat(F.lit("amount "), cents(F.col("q_amount")).cast("string")))).otherwise(_none())
    asked = queries.select("q", F.col("q_kind").alias("kind"), F.col("q_name.plain").alias("plain"), F.concat(q_days, amount, q_numbers, *facts("q")).alias("keys"))
    # a name lies in another if its rarest run is one of the other's
    names = rows.select("kind", "plain").unionByName(asked.select("kind", "plain")).where("plain <> ''").distinct()
    lists = names.select("kind", "plain", F.explode(_runs(F.col("plain"))).alias("run"))
    sizes = lists.groupBy("kind", "run").agg(F.count("*").alias("_n"))
    rare = cut(lists.join(sizes, ["kind", "run"]).groupBy("kind", "plain").agg(F.min_by("run", F.struct("_n", "run")).alias("rare")))

    def keyed(df: DataFrame, key: str, mine: str, other: str) -> DataFrame:
        # what has no name needs none
        named = df.where("plain <> ''").join(rare, ["kind", "plain"], "left").unionByName(df.where("plain = ''").withColumn("rare", F.lit(None).cast("string")))
        every = F.concat("keys", _prefixed(mine, _runs(F.col("plain"))), F.when(F.col("rare").isNotNull(), F.array(F.concat(F.lit(other), "rare"))).otherwise(_none()))
        return named.select(key, "kind", F.explode(F.array_distinct(every)).alias("key")).where("key is not null")

    wanted = cut(keyed(asked, "q", "rare of record ", "run of record "))
    met = split_join(cut(sieved(keyed(rows, "id", "run of record ", "rare of record "), wanted, ["kind", "key"])), wanted, ["kind", "key"])
    return met.select("q", "id").distinct()


def assess(pairs: DataFrame) -> DataFrame:
    """Adds ``positives, excluded, conflict, leg, same_day`` to pairs of ``read_records`` and ``read_queries``, by the rules of the record's kind."""
    yes, no = (lambda c: F.coalesce(c, F.lit(False))), (lambda c: F.coalesce(~c, F.lit(False)))
    r, q = (lambda n: F.col(f"r_{n}")), (lambda n: F.col(f"q_{n}"))
    # the facts of a pair, each once
    pairs = pairs.select(
        "*",
        (q("day") == r("day")).alias("same_day"), F.abs(q("min") - r("min")).alias("_apart"), same_service(q("number"), r("number")).alias("_service"), route_fit(q("from"), q("to"), r("from"), r("to")).alias("_route"),
        yes(F.arrays_overlap(q("people"), r("people"))).alias("_known"), titles_agree(q("name"), r("name")).alias("_named"), names_match(q("name"), r("name")).alias("_match"),
        places_overlap(q("place"), r("place")).alias("_here"), yes(q("end") > q("day")).alias("_nights"),
    )
    kind, day, apart, service, route, known, named = (F.col(c) for c in ("kind", "same_day", "_apart", "_service", "_route", "_known", "_named"))
    listed = lambda *parts: F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in parts)), lambda x: x.isNotNull())

    number, way = yes(service), yes(route)
    at_time = yes(day) & yes(apart <= 15) & ~number & ~way
    transport = listed(("date", yes(day) & (number | way | at_time)), ("number", number), ("route", way), ("time", at_time))

    nights = F.col("_nights")
    hi = F.greatest(r("last"), r("day"))
    overlap = F.when(nights, (q("day") < F.greatest(hi, r("day") + 1)) & (q("end") > r("day"))).otherwise((q("day") >= r("day")) & (q("day") <= hi))
    stay_out = no(overlap) | no(named)
    stay = listed(("name", yes(named) & ~stay_out), ("nights", yes(overlap) & nights & ~stay_out), ("date", yes(overlap) & ~nights & yes(named) & ~stay_out))

    by_name = yes(named) & F.coalesce(apart <= 120, F.lit(True))
    at_place = ~by_name & yes(apart <= 30) & q("place")["said"] & F.col("_here")
    activity = listed(("date", yes(day) & (by_name | at_place | known)), ("name", by_name), ("time", at_place), ("place", at_place), ("counterpart", known))

    fits = (q("day") <= r("until") + tolerance(kind)) & (F.coalesce(q("end"), q("day")) >= r("anchor") - tolerance(kind))
    both, is_bill = q("place")["said"] & r("place")["said"], kind == "bill"
    payee = F.when(is_bill & q("name")["said"] & r("name")["said"], F.col("_match"))
    period = F.when(is_bill & (q("period") != "") & (r("period") != ""), q("period") == r("period"))
    amount = is_bill & yes(F.abs(q("amount") - r("amount")) < 0.005)
    general = listed(("date", yes(fits)), ("place", both & F.col("_here")), ("name", (kind == "conference") & yes(named)), ("counterpart", known), ("payee", yes(payee)), ("period", yes(period)), ("amount", amount))
    general_out = no(fits) | ((kind == "trip") & both & ~F.col("_here")) | ((kind == "conference") & no(named)) | no(payee) | no(period)

    choose = lambda t, s, a, g: F.when(kind == "transport", t).when(kind == "stay", s).when(kind == "activity", a).otherwise(g)
    return pairs.select(
        "q", "id", "kind", "q_day", "same_day",
        choose(transport, stay, activity, general).alias("positives"),
        choose(no(service) | no(route) | no(day), stay_out, no(day), general_out).alias("excluded"),
        ((kind == "stay") & no(named) & yes(overlap) & nights).alias("conflict"),
        F.when(no(service) | no(route), "other").when(number | way, "same").otherwise("unknown").alias("leg"),
    )


def _bits(*conditions: Column):
    """Each condition with a power of two."""
    return ((1 << k, c) for k, c in enumerate(conditions))


def _told_apart(rows: DataFrame) -> DataFrame:
    """``q, candidates``: of each query's ``id``s the first ``SHOWN``."""
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("q").orderBy("id"))).where(F.col("_k") <= SHOWN)
    return first.groupBy("q").agg(F.array_sort(F.collect_list("id")).alias("candidates"))


def resolve(records: DataFrame, queries: DataFrame) -> DataFrame:
    """``q, answer, id, why, candidates`` for each query (``QUERIES``) against all records (``RECORDS``).

    ``answer`` is exact (a reference or a thread decides), unique (the facts leave one record), several
    (``candidates`` has the first of them) or none. A record that isn't of the query's thread never
    answers; one in a final state only to a hard key, or if ``include_closed``. A counterpart alone is
    never enough. Records and queries without an id are left out; each id must be there once.
    """
    # both are read again where they are needed: all that is known of each record takes more room than the records
    records, queries = read_records(records), read_queries(queries)
    refs = lambda c: F.filter(F.transform(F.coalesce(F.col(c), _none()), norm_ref), lambda r: F.length(r) >= 4)
    held = records.select("*", F.explode(F.array_distinct(F.concat(_prefixed("ref ", refs("refs")), _prefixed("thread ", F.col("threads"))))).alias("key"))
    mine = F.when(F.col("thread") != "", F.array(F.concat(F.lit("thread "), "thread"))).otherwise(_none())
    keys = queries.select("*", F.col("q_kind").alias("kind"), F.explode(F.array_distinct(F.concat(_prefixed("ref ", refs("q_refs")), mine))).alias("key"))
    allowed = (F.col("thread") == "") | ~F.array_contains("not_threads", F.col("thread"))
    seen = [c for c in held.columns if c.startswith("r_")]
    asked = [c for c in keys.columns if c.startswith("q_")]
    both = split_join(sieved(held.select("id", "kind", "key", "not_threads", *seen), keys, ["kind", "key"]), keys.select("q", "kind", "key", "thread", *asked), ["kind", "key"]).where(allowed)
    is_leg = F.col("kind") == "transport"
    leg = is_leg & (F.col("leg") != "other")
    # what the rules ask of a pair, as bits
    hard = assess(both).select("q", "id", sum((F.when(c, n).otherwise(0) for n, c in _bits(is_leg, F.col("q_day").isNotNull(), leg, leg & F.coalesce("same_day", F.lit(True)), leg & (F.col("leg") == "same"))), F.lit(0)).alias("is"))
    hard = cut(hard.distinct())

    is_leg, dated, legs, that_day, moved = (F.col("is").bitwiseAND(1 << k) > 0 for k in range(5))
    counts = hard.groupBy("q").agg(F.count("*").alias("n"), F.first(is_leg).alias("is_leg"), F.first(dated).alias("dated"), *(F.count(F.when(c, 1)).alias(name) for name, c in (("legs", legs), ("on_day", that_day), ("moved", moved))))
    is_leg = F.col("is_leg")
    # which of the hard ones count, and why
    chosen = F.when(~is_leg, "all").when(~F.col("dated"), "legs").when(F.col("on_day") > 0, "on_day").when(F.col("moved") == 1, "moved").otherwise("legs")
    many = F.when(~is_leg, F.col("n")).when(~F.col("dated"), F.col("legs")).when(F.col("on_day") > 0, F.col("on_day")).when(F.col("moved") == 1, F.lit(1)).otherwise(F.lit(2))
    why = F.when(~is_leg | ~F.col("dated"), "reference or thread").when(F.col("on_day") > 0, "reference and day").otherwise("reference, another day")
    decided = cut(counts.where(~is_leg | (F.col("legs") > 0)).select("q", chosen.alias("chosen"), (many == 1).alias("one"), why.alias("why")))
    counted = hard.join(decided, "q").where((F.col("chosen") == "all") | ((F.col("chosen") == "legs") & legs) | ((F.col("chosen") == "on_day") & that_day) | ((F.col("chosen") == "moved") & moved))
    first = decided.join(counted.groupBy("q").agg(F.min("id").alias("id")), "q").join(_told_apart(counted.where("not one")), "q", "left")
    first = first.select("q", F.when(F.col("one"), "exact").otherwise("several").alias("answer"), F.when(F.col("one"), F.col("id")).alias("id"), "why", "candidates")

    open_queries = queries.join(decided.select("q"), "q", "left_anti")
    pairs = cut(candidates(records, open_queries))
    pairs = pairs.join(sieved(records, pairs, ["id"]), "id").join(queries, "q").where(allowed & (F.col("include_closed") | is_open(F.col("kind"), F.col("state"))))
    scored = assess(pairs).select("q", "id", "positives", "excluded", "conflict")
    fitting = ~F.col("excluded") & (F.size("positives") > 0)
    strong = fitting & F.exists("positives", lambda p: p != "counterpart")
    scored = cut(scored.select("q", "id", F.when(strong, "strong").when(F.col("conflict"), "conflict").when(fitting, "weak").alias("rank")).where("rank is not null"))
    n = scored.groupBy("q").agg(*(F.count(F.when(F.col("rank") == r, 1)).alias(r) for r in ("strong", "conflict", "weak")))
    wanted = F.when(F.col("strong") > 0, "strong").when(F.col("conflict") > 0, "conflict").otherwise("weak")
    n = n.select("q", wanted.alias("rank"), (F.col("strong") == 1).alias("one"))
    shown = scored.join(n, ["q", "rank"])
    why = F.when(F.col("one"), "only one fits").when(F.col("rank") == "strong", "several fit").when(F.col("rank") == "conflict", "nights overlap").otherwise("only the sender matches")
    second = n.join(shown.groupBy("q").agg(F.min("id").alias("id")), "q").join(_told_apart(shown.where("not one")), "q", "left")
    second = second.select("q", F.when(F.col("one"), "unique").otherwise("several").alias("answer"), F.when(F.col("one"), F.col("id")).alias("id"), why.alias("why"), "candidates")
    found = first.unionByName(second)
    return queries.select("q").join(found, "q", "left").select("q", F.coalesce("answer", F.lit("none")).alias("answer"), "id", F.coalesce("why", F.lit("nothing fits")).alias("why"), "candidates")
