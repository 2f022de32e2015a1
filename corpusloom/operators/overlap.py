"""Joins of rows that share an element, and of names that lie in one another, by inverted lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.spread import split_join

#: Letters of the runs that names are found by; also the shortest name that may lie in another.
RUN = 5
# Domains that unrelated people share.
SHARED_DOMAINS = "gmail.com googlemail.com outlook.com hotmail.com yahoo.com icloud.com me.com proton.me protonmail.com aol.com whatsapp.net c.us g.us lid".split()


def elements(rows: DataFrame, items: str) -> DataFrame:
    """``id, element``: the distinct elements of an array column; null ones are none."""
    return rows.select("id", F.explode(F.array_distinct(F.col(items))).alias("element")).where("element is not null")


def sharing(left: DataFrame, right: DataFrame, items: str, hot: int | None = None) -> DataFrame:
    """``left_id, right_id, shared``: pairs of rows (``id`` and an array) with how many elements they share.

    Rows meet in the lists of their elements; an element that many rows have is dealt over tasks.
    Null and empty arrays share nothing; repeated rows of an id count once.
    """
    a = elements(left, items).distinct().select(F.col("id").alias("left_id"), "element")
    b = elements(right, items).distinct().select(F.col("id").alias("right_id"), "element")
    return split_join(a, b, ["element"], hot).groupBy("left_id", "right_id").agg(F.count("*").alias("shared"))


def sharing_classes(rows: DataFrame, items: str) -> tuple[DataFrame, DataFrame]:
    """``id, class_id, n``: rows with the same elements are one class, the least id its name; and ``left_id, right_id,
    shared``: pairs of classes that share an element. Copies of a row so make no pairs among themselves."""
    sets = rows.select("id", F.array_sort(F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull()))).alias("_set")).where(F.size("_set") > 0).distinct()
    classes = sets.groupBy("_set").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    members = sets.join(classes, "_set").select("id", "class_id", "n")
    heads = classes.select(F.col("class_id").alias("id"), F.col("_set").alias(items))
    return members, sharing(heads, heads, items).where("left_id < right_id")


def counterpart_keys(text: Column) -> Column:
    """What counterparts are compared by: the address, the last nine digits of a telephone number, and the last two
    labels of a domain that isn't shared by unrelated people."""
    lower = F.lower(text)
    found = F.regexp_extract(lower, r"<?([^\s<>@]+@[^\s<>@]+)>?", 1)
    address = F.when(found != "", found).otherwise(F.trim(lower))
    local = F.substring_index(text, "@", 1)
    digits = F.regexp_replace(local, r"[^0-9]", "")
    phone = F.when(~local.rlike("(?i)[a-z]") & (F.length(digits) >= 7), F.concat(F.lit("tel:"), F.right(digits, F.lit(9))))
    domain = F.substring_index(F.substring_index(address, "@", -1), ".", -2)
    domain = F.when(domain.contains(".") & ~domain.isin(*SHARED_DOMAINS), F.concat(F.lit("of:"), domain))
    return F.filter(F.array(F.concat(F.lit("at:"), address), phone, domain), lambda x: x.isNotNull())


def plain_name(name: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def names_inside(rows: DataFrame, within: list[str], name: str, least: int = RUN) -> DataFrame:
    """``within, name_a, name_b, n_a, n_b, first_a, first_b``: names of a group that are one, or of which the first lies in the second.

    Names are compared as ``plain_name`` and each once, however many rows (``id``) have it: ``n`` says how many,
    ``first`` is the least id. A name meets itself where it is there more than once; another
    that it lies in if it has ``least`` letters. Each name is looked for by its run of
    letters that the fewest names have, so no two names are compared for nothing but that run.
    """
    plain = rows.select(*within, "id", plain_name(F.col(name)).alias("name")).where("name <> ''")
    names = plain.groupBy(*within, "name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first"))
    same = names.where("n > 1").select(*within, F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("first").alias("first_a"), F.col("first").alias("first_b"))
    long = names.where(F.length("name") >= least)
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - (least - 1)), lambda k: F.substring(F.col("name"), k, F.lit(least))))
    lists = long.select(*within, "name", "n", "first", F.explode(runs).alias("run"))
    sizes = lists.groupBy(*within, "run").agg(F.count("*").alias("_size"))
    rarest = lists.join(sizes, [*within, "run"]).groupBy(*within, "name", "n", "first").agg(F.min_by("run", F.struct("_size", "run")).alias("run"))
    asked = rarest.select(*within, "run", F.col("name").alias("name_a"), F.col("n").alias("n_a"), F.col("first").alias("first_a"))
    held = lists.select(*within, "run", F.col("name").alias("name_b"), F.col("n").alias("n_b"), F.col("first").alias("first_b"))
    met = split_join(held, asked, [*within, "run"]).where("name_a <> name_b").where(F.col("name_b").contains(F.col("name_a")))
    return met.select(same.columns).unionByName(same)
