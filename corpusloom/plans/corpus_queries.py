"""Aggregates, graphs, windows, records, sets, stores and streams over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.operators import changes as X
from corpusloom.operators import diff as D
from corpusloom.operators import evaluation as V
from corpusloom.operators import ledger as K
from corpusloom.operators import overlap as O
from corpusloom.operators import records as E
from corpusloom.operators import resolve as Z
from corpusloom.operators import similarity as S
from corpusloom.operators import votes as A
from corpusloom.operators.graph import connected_components
from corpusloom.operators.spread import FEW, pick, split_join
from corpusloom.plans.notes import LINKS_SQL, links, notes
from corpusloom.sources import typed
from corpusloom.sources.lineage import tallied
from corpusloom.sources.tables import table
from corpusloom.streaming import feeds, late, upkeep

QUERIES, ORACLES = {}, {}
FLOOR = 0.3


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _vec(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _edges(spark, sf_dir):
    v = _vec(spark, sf_dir)
    return S.cosines(v, v, FLOOR, below=True).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "cosine")


_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_E = f"{_V}, e AS (SELECT a.id AS src, b.id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM v a JOIN v b ON a.id < b.id WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.3)"


@query(f"""WITH {LINKS_SQL}, p AS (SELECT src, trim(regexp_extract(dst, '^([^#|]*)', 1)) AS title, sum(n)::BIGINT AS n FROM l GROUP BY 1, 2), q AS (SELECT * FROM p WHERE title <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY src) AS k FROM q)
SELECT title, count(*) AS sources, sum(n)::BIGINT AS refs, count(*) FILTER (WHERE k <= 12 AND src IN (SELECT doc_id FROM labels WHERE quality = 1)) AS public_demand FROM r GROUP BY 1
HAVING count(*) >= 2 OR public_demand > 0 ORDER BY public_demand DESC, sources DESC, refs DESC, title LIMIT 3""")
def agg_wanted(spark, sf_dir):
    published = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("src"))
    return A.wanted_topics(links(spark, sf_dir), published)


@query(f"""WITH {_E}, n AS (SELECT src AS entry, dst AS other, cosine FROM e UNION ALL SELECT dst, src, cosine FROM e),
t AS (SELECT entry, cosine, unnest([d.lang, d.source]) AS tag FROM n JOIN documents d ON d.doc_id = other), g AS (SELECT entry, lower(tag) AS tag, round(sum(cosine), 6) AS weight, count(*) AS sources FROM t GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY weight DESC, tag) AS rank FROM g WHERE sources >= 2 OR weight >= 0.85) WHERE rank <= 3""")
def agg_tags(spark, sf_dir):
    v, d = _vec(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("lang").alias("lang"), F.lower("source").alias("source"))
    # numbers stand for tags, of which each vector's document has two
    tags, (n,) = tallied(d.select(F.explode(F.array("lang", "source")).alias("tag")).distinct())
    tags = tags.withColumn("grp", F.monotonically_increasing_id())
    for name in ("lang", "source"):
        told = tags.select(F.col("tag").alias("_tag"), F.col("grp").alias(f"n_{name}"))
        d = d.join(F.broadcast(told) if n <= FEW else told, F.col(name).eqNullSafe(F.col("_tag"))).drop("_tag")
    votes = S.sums_by_group(v, v.join(d, "id"), FLOOR, "n_lang", "n_source")
    return A.suggest_tags(votes.join(tags, "grp").select(F.col("query_id").alias("entry"), "tag", "cosine", F.col("n").alias("sources")))


def agg_placement(spark, sf_dir):
    """Where a link target belongs by the folders of the pages that link to it. No SQL twin: a test has the cases."""
    folder = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "/[^/]*$", "")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), folder.alias("folder"))
    return A.placement(links(spark, sf_dir).join(pages, "src").select(F.col("dst").alias("entry"), "folder", F.col("n").cast("double").alias("weight")))


QUERIES["agg_placement"] = agg_placement


_FOLDERS = """f AS (SELECT doc_id, lang || '/' || source || CASE WHEN doc_id % 3 = 0 THEN '/deep' ELSE '' END AS folder, 'q' || doc_id % 700 AS entry, 1.0::DOUBLE + doc_id % 4 AS weight FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)"""


@query(f"""WITH {_FOLDERS}, t AS (SELECT entry, sum(weight) AS total FROM f GROUP BY 1 HAVING count(*) >= 2 AND sum(weight) > 0), p AS (SELECT entry, weight, string_split(folder, '/') AS p FROM f),
s AS (SELECT entry, weight, p, unnest(range(len(p))) AS step FROM p), a AS (SELECT entry, step, array_to_string(p[1:len(p) - step], '/') AS folder, sum(weight) AS weight FROM s GROUP BY ALL),
w AS (SELECT a.*, row_number() OVER (PARTITION BY entry ORDER BY step) AS k FROM a JOIN t USING (entry) WHERE folder <> '' AND a.weight > total / 2) SELECT entry, folder FROM w WHERE k = 1""")
def agg_folder_vote(spark, sf_dir):
    """Where an entry belongs by the folders of its neighbours, weighted, those without a majority asked for the folder above."""
    d = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    folder = F.concat(F.concat_ws("/", "lang", "source"), F.when(F.col("doc_id") % 3 == 0, "/deep").otherwise(""))
    votes = d.select(F.concat(F.lit("q"), (F.col("doc_id") % 700).cast("string")).alias("entry"), folder.alias("folder"), (1.0 + F.col("doc_id") % 4).alias("weight"))
    return A.placement(votes)


_CHUNKED = """c AS (SELECT vec_id // 4 AS note, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT DISTINCT note FROM c), k AS (SELECT note AS src, note + 1 AS dst FROM n UNION SELECT note, note + 7 FROM n),
p AS (SELECT a.note AS src, b.note AS dst, max(round(list_cosine_similarity(a.v, b.v), 6)) AS score FROM c a JOIN c b ON a.note <> b.note AND b.note % 11 <> 0 GROUP BY 1, 2),
r AS (SELECT src, dst, score, (SELECT count(*) FROM p o WHERE o.src = p.src AND o.score > p.score) + 1 AS rank FROM p JOIN k USING (src, dst))"""


@query(f"WITH {_CHUNKED} SELECT src, dst, score, rank FROM r")
def eval_link_ranks(spark, sf_dir):
    """The rank of each note's links (to the next note and the seventh after) among all notes by their best pair of chunks; every eleventh note is quiet."""
    return V.link_ranks(*_linked_chunks(spark, sf_dir))


def _linked_chunks(spark, sf_dir):
    c = _vec(spark, sf_dir).select(F.floor(F.col("id") / 4).cast("long").alias("note"), "v")
    n = c.select("note").distinct()
    links = n.select(F.col("note").alias("src"), F.explode(F.array(F.col("note") + 1, F.col("note") + 7)).alias("dst"))
    return c, links, F.col("note") % 11 != 0


@query(f"""WITH {_CHUNKED}, s AS (SELECT src, count(*) AS n, avg((rank <= 5)::INT) AS r5, avg((rank <= 10)::INT) AS r10, 1.0::DOUBLE / min(rank) AS first, sum(1.0::DOUBLE / rank) AS each FROM r GROUP BY 1)
SELECT count(*) AS sources, sum(n)::BIGINT AS pairs, round(avg(r5) + 1e-9, 6) AS recall_5, round(avg(r10) + 1e-9, 6) AS recall_10, round(avg(first) + 1e-9, 6) AS mrr_first, round(sum(each) / sum(n) + 1e-9, 6) AS mrr_per_link FROM s""")
def eval_links(spark, sf_dir):
    """The same as recalls and mean reciprocal ranks."""
    s = V.link_summary(V.link_ranks(*_linked_chunks(spark, sf_dir)))
    return s.select("sources", "pairs", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("recall_5", "recall_10", "mrr_first", "mrr_per_link")))


@query(f"""WITH {_E}, n AS (SELECT src AS entry, dst AS other, cosine FROM e UNION ALL SELECT dst, src, cosine FROM e)
SELECT entry, round(coalesce(sum(cosine) FILTER (WHERE v.label % 2 = 1), 0) / sum(cosine), 6) AS affinity FROM n JOIN v ON v.id = other GROUP BY 1""")
def agg_affinity(spark, sf_dir):
    e = _edges(spark, sf_dir)
    both = e.select(F.col("src").alias("entry"), F.col("dst").alias("id"), "cosine").unionByName(e.select(F.col("dst").alias("entry"), F.col("src").alias("id"), "cosine"))
    n = both.join(_vec(spark, sf_dir).select("id", "label"), "id").select("entry", "cosine", (F.col("label") % 2 == 1).alias("journal"))
    return A.affinity(n).select("entry", F.round("affinity", 6).alias("affinity"))


@query("""SELECT o_orderkey AS trip, l_returnflag AS kind, n_name AS currency, count(*) AS items, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 2) AS cost, round(coalesce(sum(l_extendedprice::DECIMAL(18,2)) FILTER (WHERE l_linestatus = 'F'), 0)::DOUBLE, 2) AS paid,
count(DISTINCT l_shipdate::DATE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((1, 2, 3), (1, 3))""")
def agg_trip_cost(spark, sf_dir):
    """Cost of each trip by kind and currency, and in all."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("o_orderkey").alias("trip"), F.col("l_returnflag").alias("kind"), F.col("n_name").alias("currency"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), (F.col("l_linestatus") == "F").alias("done"), F.col("l_shipdate").cast("date").alias("day"))
    out = rows.groupingSets([[F.col("trip"), F.col("kind"), F.col("currency")], [F.col("trip"), F.col("currency")]], "trip", "kind", "currency")
    return out.agg(F.count("*").alias("items"), F.round(F.sum("price").cast("double"), 2).alias("cost"), F.round(F.coalesce(F.sum(F.when(F.col("done"), F.col("price"))), F.lit(0)).cast("double"), 2).alias("paid"), F.count_distinct("day").alias("days"))


@query("SELECT source AS first, CASE WHEN grouping(lang) = 0 THEN lang END AS second, count(*) AS notes FROM documents GROUP BY GROUPING SETS ((source), (source, lang))")
def agg_folder_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("first"), F.col("lang").alias("second"))
    return d.groupingSets([[F.col("first")], [F.col("first"), F.col("second")]], "first", "second").agg(F.count("*").alias("notes"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS f, trim(substr(text, 1, 60)) AS title, text FROM documents), w AS (SELECT *, CASE WHEN f = '' THEN 0 ELSE len(string_split(f, ' ')) END AS n FROM f),
s AS (SELECT doc_id, title, CASE WHEN n < 40 THEN 3 WHEN n < 120 THEN 1 ELSE 0 END + (regexp_matches(text, '(?m)^\s*- \[ \]') OR regexp_matches(text, '(^|[^A-Za-z0-9_])TODO([^A-Za-z0-9_]|$)'))::INT AS score, coalesce(quality = 1, false) AS published FROM w LEFT JOIN labels USING (doc_id))
SELECT doc_id, score, published FROM s WHERE score > 0 ORDER BY published DESC, score DESC, title, doc_id LIMIT 2""")
def agg_fill_out(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = d.select("doc_id", F.struct(F.trim(F.substring("text", 1, 60)), "doc_id").alias("title"), P.incompleteness(F.col("text"), F.lit(0)).alias("score"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("published"))
    return A.rank_fill_out(rows).select("doc_id", "score", "published")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, unnest(['status', 'priority', 'year']) AS property, unnest([o_orderstatus, o_orderpriority, year(o_orderdate)::VARCHAR]) AS value FROM orders)
SELECT o_custkey, o_orderkey, property, coalesce(value, '') AS value FROM l WHERE (o_custkey, property) IN (SELECT (o_custkey, property) FROM l GROUP BY o_custkey, property HAVING count(DISTINCT coalesce(value, '')) > 1)""")
def agg_distinguishing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").cast("string").alias("year"))
    return A.distinguishing(o, "o_custkey", "o_orderkey", ["status", "priority", "year"])


@query(f"""WITH {_E}, n AS (SELECT src AS entry, dst AS other, cosine FROM e UNION ALL SELECT dst, src, cosine FROM e)
SELECT entry, other, quality, k AS rank FROM (SELECT entry, other, quality, row_number() OVER (PARTITION BY entry ORDER BY cosine DESC, other) AS k FROM n JOIN labels ON doc_id = other) WHERE k <= 3""")
def agg_precedents(spark, sf_dir):
    """The three nearest neighbours with a human decision."""
    v, labels = _vec(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("other"), "quality")
    decided = v.join(labels.select(F.col("other").alias("id")), "id", "left_semi")
    near = S.cosines(v, decided, FLOOR, 3).select(F.col("query_id").alias("entry"), F.col("id").alias("other"), "cosine")
    ranked = near.join(labels, "other")
    k = F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("cosine"), "other"))
    return ranked.withColumn("rank", k).where("rank <= 3").select("entry", "other", "quality", "rank")


@query("SELECT event_id, user_id, round(sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 100.0::DOUBLE, 2) AS spent FROM events")
def agg_cost_running(spark, sf_dir):
    """What each user has spent so far."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.sum(cents).over(by) / 100.0, 2).alias("spent"))


@query(f"WITH {LINKS_SQL} SELECT dst, count(DISTINCT src) AS sources, sum(n)::BIGINT AS refs FROM l GROUP BY 1")
def graph_backlinks(spark, sf_dir):
    return A.backlinks(links(spark, sf_dir))


@query(f"""WITH {LINKS_SQL}, b AS (SELECT 'p' || src AS a, dst AS b FROM l UNION SELECT dst, 'p' || src FROM l), s AS (SELECT DISTINCT a AS node FROM b),
o AS (SELECT node, b AS near FROM s JOIN b ON a = node), t AS (SELECT node, b AS near FROM o JOIN b ON a = near) SELECT DISTINCT node, near FROM (SELECT * FROM o UNION ALL SELECT * FROM t) WHERE near <> node""")
def graph_two_hop(spark, sf_dir):
    e = links(spark, sf_dir).select(F.concat(F.lit("p"), F.col("src").cast("string")).alias("src"), "dst")
    return A.two_hop(e)


_CC = f"""WITH RECURSIVE {_E}, b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(node, seen) AS (SELECT a, a FROM b UNION SELECT r.node, b.b FROM r JOIN b ON b.a = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1)"""


@query(f"{_CC} SELECT node, component FROM c")
def graph_components(spark, sf_dir):
    return connected_components(S.linking(_vec(spark, sf_dir), FLOOR))


@query(f"""{_CC}, m AS (SELECT node, max(cosine) AS cosine FROM (SELECT src AS node, dst AS other, cosine FROM e UNION ALL SELECT dst, src, cosine FROM e) JOIN v ON v.id = other WHERE label = 0 GROUP BY 1)
SELECT component, count(*) AS size FROM c LEFT JOIN m USING (node) GROUP BY 1 HAVING count(*) >= 3 AND coalesce(max(cosine), 0) < 0.45""")
def graph_themes(spark, sf_dir):
    v = _vec(spark, sf_dir)
    covered = S.cosines(v, v.where("label = 0"), FLOOR, 1).groupBy(F.col("query_id").alias("node")).agg(F.max("cosine").alias("cosine"))
    return A.themes(S.linking(v, FLOOR), covered, cover=0.45)


@query(f"""WITH RECURSIVE {_V}, s AS (SELECT v.*, coalesce(text[1:60], 'vector ' || id) AS snippet FROM v LEFT JOIN documents ON doc_id = id),
p AS (SELECT a.id AS src, b.id AS dst, b.label, b.snippet, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM s a JOIN s b ON a.id <> b.id WHERE a.label <> 0),
e AS (SELECT * FROM p WHERE label <> 0 AND cosine >= 0.38), r(node, seen) AS (SELECT src, src FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY 1),
m AS (SELECT src AS node, max(cosine) AS cosine FROM p WHERE label = 0 AND cosine >= 0.3 GROUP BY 1), k AS (SELECT component, count(*) AS size, coalesce(max(cosine), 0) AS best FROM c LEFT JOIN m USING (node) GROUP BY 1 HAVING count(*) >= 3 AND coalesce(max(cosine), 0) < 0.4),
d AS (SELECT component, snippet, max(cosine) AS cosine FROM e JOIN c ON c.node = e.src GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY cosine DESC, snippet) AS n FROM d)
SELECT component, any_value(size) AS size, any_value(best) AS best, string_agg(snippet, ' | ' ORDER BY n) AS evidence FROM k JOIN f USING (component) WHERE n <= 4 GROUP BY 1""")
def graph_theme_evidence(spark, sf_dir):
    """Thoughts that come again in dated entries and that no permanent note (label 0) holds yet, with the nearest of what they say."""
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("dst"), F.substring("text", 1, 60).alias("snippet"))
    v = _vec(spark, sf_dir)
    dated, permanent = v.where("label <> 0"), v.where("label = 0")
    # of what finds an entry the nearest tells how near its snippet is
    best = S.cosines(dated, dated, 0.38, 1).select(F.col("query_id").alias("dst"), F.col("id").alias("src"), "cosine")
    hits = best.join(text, "dst", "left").withColumn("snippet", F.coalesce("snippet", F.concat(F.lit("vector "), F.col("dst").cast("string"))))
    near = S.cosines(dated, permanent, FLOOR, 1).select(F.col("query_id").alias("node"), "cosine")
    return A.theme_evidence(hits, near, 0.38, cover=0.4, joined=S.linking(dated, 0.38)).withColumn("evidence", F.array_join("evidence", " | "))


@query(f"""WITH {_E}, w AS (SELECT label AS thread, id AS entry FROM v WHERE label < 3), b AS (SELECT src, dst, cosine FROM e UNION ALL SELECT dst, src, cosine FROM e)
SELECT thread, src AS entry, max(cosine) AS cosine FROM b JOIN w ON entry = dst WHERE src NOT IN (SELECT entry FROM w) GROUP BY 1, 2""")
def graph_weave(spark, sf_dir):
    woven = _vec(spark, sf_dir).where("label < 3").select(F.col("label").alias("thread"), F.col("id").alias("entry"))
    return A.weave(_edges(spark, sf_dir), woven)


@query("""SELECT o_orderkey, p AS previous FROM (SELECT o_orderkey, max(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)::DATE AS p FROM orders)""")
def win_prev_entry(spark, sf_dir):
    """The day of each customer's entry before, same days left out."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy("o_custkey").orderBy("d").rangeBetween(Window.unboundedPreceding, -1)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"), day.alias("d"))
    return o.select("o_orderkey", F.max("day").over(before).alias("previous"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM orders) SELECT a.o_orderkey, b.o_orderkey AS other FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND strftime(a.day, '%m-%d') = strftime(b.day, '%m-%d') AND a.o_orderkey <> b.o_orderkey""")
def win_on_this_day(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "MM-dd").alias("key"))
    return split_join(o, o.withColumnRenamed("o_orderkey", "other"), ["o_custkey", "key"]).where("o_orderkey <> other").select("o_orderkey", "other")


_LINES = r"ln AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))"


@query(rf"WITH {_LINES}, h AS (SELECT *, CASE WHEN length(line) < 80 THEN md5(line) END AS head FROM ln) SELECT doc_id, line_no, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM h")
def win_carry_forward(spark, sf_dir):
    """The last short line at or above each line."""
    ln = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    by = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return ln.select("doc_id", "line_no", F.last(F.when(F.length("line") < 80, F.md5("line")), True).over(by).alias("heading"))


@query(rf"WITH {_LINES}, h AS (SELECT *, CASE WHEN length(line) % 7 = 0 THEN line_no END AS mark FROM ln) SELECT doc_id, line_no, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS mark FROM h")
def win_nearest_above(spark, sf_dir):
    """The nearest marked line at most 60 lines above each line."""
    ln = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    by = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-60, 0)
    return ln.select("doc_id", "line_no", F.last(F.when(F.length("line") % 7 == 0, F.col("line_no")), True).over(by).alias("mark"))


@query("SELECT event_id, user_id, k AS rank FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def win_latest_n(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").select("event_id", "user_id", k.alias("rank")).where("rank <= 5")


@query("SELECT user_id, event_type, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def win_dedup_key(spark, sf_dir):
    """The first event of each key, by partial aggregation rather than a window."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(r"""WITH n AS (SELECT source, doc_id, source || '/' || doc_id || '.md' AS path, len(regexp_extract_all(text, '\[\[[^\]]+\]\]')) AS links, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS mtime FROM documents WHERE length(trim(text)) > 0),
c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY path) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM n WHERE links <= 1 AND TIMESTAMP '2026-11-18' - mtime > INTERVAL 30 DAY AND NOT regexp_matches(doc_id::VARCHAR, '^[0-9]{4}$')),
d AS (SELECT list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, 11), lambda i: ascii(substr('2026-11-18', i, 1))::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS h)
SELECT source AS folder, doc_id FROM c, d WHERE k = h % n""")
def win_daily_pick(spark, sf_dir):
    """One old, hardly linked note of each folder for a day, the same all day; dated ones aside."""
    today = F.lit("2026-11-18")
    links = F.size(F.regexp_extract_all("content", F.lit(r"\[\[[^\]]+\]\]"), F.lit(0)))
    old = F.unix_timestamp(today.cast("timestamp")) - F.unix_timestamp("mtime") > 30 * 86400
    n = notes(spark, sf_dir).where((F.length(F.trim("content")) > 0) & (links <= 1) & old & ~P.looks_periodic(F.col("path"))).select("folder", "doc_id", "path")
    return pick(n, ["folder"], ["path"], T.fnv1a(today)).select("folder", "doc_id")


def _records(spark, sf_dir):
    """Line items as records of their orders: from the order to the shipment."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("stay").alias("kind"), F.when(F.col("l_linestatus") == "F", "done").otherwise("booked").alias("state"), F.col("o_orderdate").alias("start"), F.col("l_shipdate").alias("end"), F.col("o_custkey").alias("parent"), F.col("l_orderkey").alias("trip"))


_R = "r AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'booked' END AS state, o_orderdate AS s, l_shipdate AS e, o_custkey AS parent FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"WITH {_R} SELECT id FROM r WHERE e < s")
def rec_audit_reversed(spark, sf_dir):
    return E.reversed_dates(_records(spark, sf_dir)).select("id")


@query(f"WITH {_R} SELECT id FROM r WHERE state <> 'done' AND coalesce(e, s)::DATE < DATE '1998-06-01'")
def rec_audit_still_open(spark, sf_dir):
    return E.still_open(_records(spark, sf_dir), "1998-06-01").select("id")


@query(f"WITH {_R} SELECT id FROM r WHERE parent NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def rec_audit_missing_parent(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("parent"))
    return E.missing_parent(_records(spark, sf_dir), known, "parent").select("id")


@query("SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate::DATE < o_orderdate::DATE OR l_shipdate::DATE > o_orderdate::DATE + 90")
def rec_audit_outside(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("start"), F.col("l_orderkey").alias("trip"))
    trips = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), F.col("o_orderdate").alias("p_start"), F.date_add("o_orderdate", 90).alias("p_end"))
    return E.outside_parent(li, trips, "trip").select("id")


@query("""WITH s AS (SELECT o_custkey, o_orderkey AS id, o_orderdate::DATE AS lo, o_orderdate::DATE + 3 AS hi FROM orders) SELECT a.o_custkey, a.id AS a, b.id AS b FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.id < b.id AND a.lo < b.hi AND b.lo < a.hi""")
def rec_audit_overlap(spark, sf_dir):
    stays = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"), F.date_add("o_orderdate", 3).alias("end"))
    return E.overlapping(stays, "o_custkey", 3)


@query("""SELECT l_suppkey AS parent, l_shipdate::DATE AS day, l_returnflag AS kind, count(*) AS copies, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def rec_audit_twice(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("parent"), F.col("l_shipdate").alias("start"), F.col("l_returnflag").alias("kind"), F.lit("").alias("name"))
    return E.twice(li, "parent").select("parent", "day", "kind", "copies", "first")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def rec_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT' and o_orderdate >= '1995-01-01' and o_orderdate < '1997-01-01'")
    return o.orderBy("o_orderdate", "o_orderkey").limit(200).select("o_orderkey")


_BILL = """WITH q AS (SELECT o_orderkey AS q, o_custkey, strftime(o_orderdate, '%Y-%m') AS period, round(o_totalprice, 2) AS amount FROM orders),
c AS (SELECT a.q, b.q AS record, (a.period = b.period)::INT AS positives FROM q a JOIN q b ON a.o_custkey = b.o_custkey AND a.q <> b.q)
SELECT q, CASE WHEN sum(positives) = 1 THEN 'unique' WHEN sum(positives) > 1 THEN 'several' ELSE 'none' END AS answer, CASE WHEN sum(positives) = 1 THEN min(record) FILTER (WHERE positives = 1) END AS record FROM c GROUP BY 1"""


@query(_BILL)
def rec_resolve_bill(spark, sf_dir):
    """Which other bill of a payee an observation of one means, by its period."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), "o_custkey", F.concat(F.lit("payee "), "o_custkey").alias("payee"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_totalprice").alias("amount"))
    q = o.toDF("q", "o_custkey", "q_payee", "q_period", "q_amount").withColumn("q_amount", F.lit(None).cast("double"))
    scored = E.assess_bill(split_join(o, q, ["o_custkey"]).where("q <> record"))
    no = F.lit(False)
    # the payee alone is never enough
    fit = scored.select("q", "record", (F.col("positives") >= 2).cast("int").alias("positives"), "excluded", no.alias("hard"), no.alias("conflict"))
    none = q.select("q").join(fit.where("not excluded").select("q").distinct(), "q", "left_anti").join(scored.select("q").distinct(), "q", "left_semi")
    return E.resolve(fit, "q").unionByName(none.select("q", F.lit("none").alias("answer"), F.lit(None).cast("long").alias("record")))


@query("""WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS o, l_shipdate::DATE AS d, l_suppkey AS s, l_returnflag <> 'R' AS open, l_partkey % 5 AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_returnflag) = 1),
q AS (SELECT id AS q, v, o, CASE v WHEN 0 THEN d WHEN 1 THEN d + 4000 WHEN 3 THEN d END AS d, CASE WHEN v IN (1, 3) THEN s END AS s FROM r WHERE id % 20 = 0),
h AS (SELECT q, q.d AS qd, r.id, r.d = q.d AS same, q.s IS NOT NULL AS told FROM q JOIN r ON r.o = q.o AND (q.s IS NULL OR r.s = q.s) WHERE q.v < 3),
n AS (SELECT q, qd, count(*) AS legs, count(*) FILTER (coalesce(same, TRUE)) AS on_day, count(*) FILTER (told) AS moved FROM h GROUP BY 1, 2),
w AS (SELECT q, CASE WHEN qd IS NULL THEN 'legs' WHEN on_day > 0 THEN 'on_day' WHEN moved = 1 THEN 'moved' ELSE 'legs' END AS w, CASE WHEN qd IS NULL THEN legs = 1 WHEN on_day > 0 THEN on_day = 1 ELSE moved = 1 END AS one FROM n),
f AS (SELECT q, one, id FROM h JOIN w USING (q) WHERE w <> 'on_day' OR coalesce(same, TRUE)),
t AS (SELECT q, r.id FROM q JOIN r ON r.s = q.s AND r.d = q.d AND r.open WHERE q.v = 3),
a AS (SELECT q, CASE WHEN one THEN 'exact' ELSE 'several' END AS answer, min(id) AS id, list_sort(list(id))[1:6] AS c, one FROM f GROUP BY q, one UNION ALL SELECT q, CASE count(*) WHEN 1 THEN 'unique' ELSE 'several' END, min(id), list_sort(list(id))[1:6], count(*) = 1 FROM t GROUP BY q)
SELECT q, coalesce(answer, 'none') AS answer, CASE WHEN one THEN id END AS id, CASE WHEN NOT one THEN array_to_string(c, ',') END AS candidates FROM q LEFT JOIN a USING (q)""")
def rec_resolve_leg(spark, sf_dir):
    """Which journey an observation means: every twentieth one asks, by its booking with the day, with its service on another
    day, or alone, by its service and day, or by nothing. Lines of an order are the legs of a booking, suppliers their services."""
    # a line that is there more than once counts once; only orders that may hold such lines are grouped by line
    line = F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")).alias("l")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
    lines = F.bit_count(F.bit_or(F.expr("shiftleft(1L, cast(pmod(l_linenumber, 63) as int))")))
    doubtful, (n,) = tallied(li.groupBy("l_orderkey").agg(F.count("*").alias("n"), lines.alias("lines")).where("n <> coalesce(lines, 0)").select("l_orderkey"))
    doubtful = F.broadcast(doubtful) if n <= FEW else doubtful
    again = li.join(doubtful, "l_orderkey", "left_semi").groupBy("l_orderkey", "l_linenumber").agg(line).select("l_orderkey", "l_linenumber", "l.*")
    li = li.join(doubtful, "l_orderkey", "left_anti").unionByName(again)
    number, none = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.lit(None)
    cell = {"id": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "kind": F.lit("transport"), "state": F.when(F.col("l_returnflag") == "R", "cancelled").otherwise("booked"), "refs": F.array(F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string"))), "start": F.date_format("l_shipdate", "yyyy-MM-dd"), "fields": F.create_map(F.lit("number"), number)}
    records = li.select(*(cell.get(c.split()[0], none).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in Z.RECORDS.split(", ")))
    v, day = F.col("l_partkey") % 5, F.to_date("l_shipdate")
    date = F.when(v.isin(0, 3), day).when(v == 1, F.date_add(day, 4000))
    asks = {"q": cell["id"], "kind": F.lit("transport"), "refs": F.when(v < 3, F.array(F.concat(F.lit("ord "), F.col("l_orderkey").cast("string")))), "date": F.date_format(date, "yyyy-MM-dd"), "number": F.when(v.isin(1, 3), number)}
    queries = li.where(cell["id"] % 20 == 0).select(*(asks.get(c.split()[0], none).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in Z.QUERIES.split(", ")))
    return Z.resolve(records, queries).select("q", "answer", "id", F.array_join("candidates", ",").alias("candidates"))


@query("""WITH q AS (SELECT o_orderkey AS q, o_custkey, o_orderdate::DATE AS lo, o_orderdate::DATE + 3 AS hi FROM orders), c AS (SELECT a.q, b.q AS record FROM q a JOIN q b ON a.o_custkey = b.o_custkey AND a.q <> b.q AND a.lo < b.hi AND b.lo < a.hi)
SELECT q, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'several' END AS answer, CASE WHEN count(*) = 1 THEN min(record) END AS record FROM c GROUP BY 1""")
def rec_resolve_stay(spark, sf_dir):
    """Which other stay of a guest an observation of nights means."""
    stays = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("start"), F.date_add("o_orderdate", 3).alias("end"))
    met = E.overlapping(stays, "o_custkey", 3)
    both = met.select(F.col("a").alias("q"), F.col("b").alias("record")).unionByName(met.select(F.col("b").alias("q"), F.col("a").alias("record")))
    days = stays.select("id", F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("end", "yyyy-MM-dd").alias("end"))
    pairs = both.join(days.toDF("record", "start", "end"), "record").join(days.toDF("q", "q_date", "q_end"), "q")
    scored = E.assess_stay(pairs.withColumn("title", F.lit("")).withColumn("q_name", F.lit("")))
    return E.resolve(scored.select("q", "record", "positives", "excluded", F.lit(False).alias("hard"), "conflict"), "q")


@query("""SELECT user_id, count(*) AS entries, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1""")
def rec_ledger_state(spark, sf_dir):
    return E.ledger_state(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "entries", "event_type", "ts")


def _ledger_events(spark, sf_dir):
    """events as what happens to the records of a user: views and clicks submit, purchases approve, signups take back,
    errors dismiss, are checked again or write by hand; texts are one of three, or none."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    n, kind = F.col("event_id"), F.col("event_type")
    text = lambda k: F.when(k % 4 < 3, F.concat(F.lit("text "), (k % 4).cast("string")))
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), (F.floor(F.col("value")) % 9).cast("string")).alias("key"),
        F.col("ts").alias("at"), n.alias("seq"),
        F.when(kind.isin("view", "click"), "submit").when(kind == "purchase", "approve").when(kind == "signup", "undo").otherwise(F.element_at(F.array(*map(F.lit, ("dismiss", "recheck", "edit", "sweep"))), (n % 4 + 1).cast("int"))).alias("op"),
        F.when(kind == "error", F.element_at(F.array(*map(F.lit, ("dismiss", "apply", "", "approve"))), (n % 4 + 1).cast("int"))).when(n % 7 == 0, "reject").when(n % 3 == 0, "review").otherwise("apply").alias("plan"),
        F.when(kind.isin("view", "click"), text(F.floor(n / 4))).alias("before"), F.when(kind.isin("view", "click", "error"), text(n)).alias("after"),
        F.when(n % 2 == 0, "thread").alias("thread"), F.lit("client").alias("client"), F.concat(F.lit("event "), n.cast("string")).alias("reason"),
    )


def rec_ledger_fold(spark, sf_dir):
    """Every key's entry after all events, in order, record by record. No SQL twin: each step depends on the one before; a test compares with a plain loop."""
    return K.entries_of(K.fold(_ledger_events(spark, sf_dir))).select("path", "key", "status", "reason", "undo", "written_seq")


QUERIES["rec_ledger_fold"] = rec_ledger_fold


_OLD = "o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0)"


@query(f"WITH {_OLD} SELECT doc_id, CASE WHEN o.text IS NULL THEN 'create' WHEN n.text IS NULL THEN 'delete' ELSE 'modify' END AS type, md5(o.text) AS before_hash, md5(n.text) AS after_hash FROM o FULL JOIN n USING (doc_id) WHERE o.text IS DISTINCT FROM n.text")
def rec_change_set(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = d.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text")))
    return X.change_set(old, d.where("doc_id % 11 <> 0"), "doc_id", "text")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' WHEN doc_id % 11 = 0 THEN 'vanished' ELSE 'changed' END AS change FROM documents WHERE (doc_id % 7 = 0 AND doc_id % 11 <> 0) OR (doc_id % 7 <> 0 AND (doc_id % 11 = 0 OR doc_id % 5 = 0))")
def store_stale_diff(spark, sf_dir):
    n = notes(spark, sf_dir).select("doc_id", "mtime")
    old = n.where("doc_id % 7 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 5 == 0, F.col("mtime") - F.expr("interval 1 hour")).otherwise(F.col("mtime")))
    return X.stale(old, n.where("doc_id % 11 <> 0"), "doc_id", "mtime")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def store_backfill(spark, sf_dir):
    return X.backfill(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("SELECT source, any_value(n) AS n, count(doc_id) AS found FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) LEFT JOIN (SELECT source, doc_id FROM documents WHERE doc_id % 40 <> 3) USING (source) GROUP BY source HAVING any_value(n) <> count(doc_id)")
def store_drift(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return X.drifted(d.groupBy("source").agg(F.count("*").alias("n")), d.where("doc_id % 40 <> 3"), "source", "n")


@query(r"""WITH t AS (SELECT conv_id, turn, list_distinct(string_split(text, ' ')) AS w, string_split(text, ' ') AS o FROM conversations), j AS (SELECT a.conv_id, a.turn, list_concat(a.o, b.o) AS o FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
u AS (SELECT conv_id, turn, unnest(o) AS w, generate_subscripts(o, 1) AS i FROM j), d AS (SELECT conv_id, turn, w, min(i) AS i FROM u GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i DESC) AS k FROM d)
SELECT conv_id, turn, md5(string_agg(w, ' ' ORDER BY i)) AS tail FROM k WHERE k <= 60 GROUP BY 1, 2""")
def set_union_tail(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.md5(F.array_join(X.union_tail(F.col("w"), F.col("v")), " ")).alias("tail"))


def set_block_union(spark, sf_dir):
    """Lines of each document that the one before lacks."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("kept"))
    return d.join(before, "doc_id").select("doc_id", F.size(X.block_union(F.col("kept"), F.col("text"))).alias("blocks"))


QUERIES["set_block_union"] = set_block_union


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_unwoven(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "embeddings").select("vec_id"))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def stream_upsert(spark, sf_dir):
    feed = feeds.stream(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return feeds.upsert(feed, "user_id", ["ts", "event_id"]).select("user_id", "ts", "event_type")


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_idempotent(spark, sf_dir):
    feed = feeds.stream(spark, sf_dir, "events").select("user_id", "event_type")
    return feeds.idempotent(feed, ["user_id", "event_type"])


def _events(spark, sf_dir):
    return feeds.stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain_times(df):
    return df.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), *[c for c in df.columns if c not in ("start", "end")])


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Extension: hourly counts by type."""
    return _plain_times(feeds.windowed(_events(spark, sf_dir), "ts", F.window("ts", "1 hour"), ["event_type"]))


@query("""SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(2) r(k) GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    """Extension: hours that start every half hour."""
    return _plain_times(feeds.windowed(_events(spark, sf_dir), "ts", F.window("ts", "1 hour", "30 minutes"), ["event_type"]))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    """Extension: sessions of a user, parted by half an hour (as a batch: sessions have no update mode)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return n.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n", "total")


def _files(spark, df, name, many=8):
    """A table as a feed of ``many`` files, each with rows of all times, some at a trigger."""
    home = feeds._home(spark)
    df.repartition(many, "event_id").write.parquet(f"{home}/{name}.parquet")
    return feeds.stream(spark, home, name, 2), home


_CHANGES = """c AS (SELECT 'u' || user_id || '/' || event_id % 5 AS path, 'u' || user_id || '/' || (event_id + 2) % 5 AS old_path, event_type, value, ts AS t, event_id AS seq FROM events),
e AS (SELECT path, event_type = 'error' AS gone, value, event_type, t, seq FROM c UNION ALL SELECT old_path, TRUE, value, event_type, t, seq FROM c WHERE event_type = 'signup'),
l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY t DESC, seq DESC, gone) AS k FROM e)"""


def _changes(spark, sf_dir):
    """events as changes of a user's five notes: errors delete, signups rename, all others write."""
    e = table(spark, sf_dir, "events")
    note = lambda k: F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), ((F.col("event_id") + k) % 5).cast("string"))
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "rename").otherwise("modify")
    return e.select("event_id", note(0).alias("path"), F.when(op == "rename", note(2)).alias("old_path"), op.alias("op"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), "event_type", "value")


def _letters(note):
    """A note's units: the letters of its type."""
    return [(c, k) for k, c in enumerate(note["event_type"])]


def _letters_of_small(note):
    if note["value"] >= 80:
        raise ValueError("too large")
    return _letters(note)


@query(f"WITH {_CHANGES} SELECT path, seq, event_type, length(event_type)::BIGINT AS n FROM l WHERE k = 1 AND NOT gone")
def stream_index(spark, sf_dir):
    """The index after a feed of creates, deletes and renames in files that are out of order: notes and how many units each has."""
    feed, home = _files(spark, _changes(spark, sf_dir), "changes")
    upkeep.follow(feed.drop("event_id"), home, _letters, "letter string, place int", 16)
    n = upkeep.units(spark, home).groupBy("path").agg(F.count("*").alias("n"))
    return upkeep.notes(spark, home).join(n, "path").select("path", "seq", "event_type", "n")


@query(f"WITH {_CHANGES} SELECT path, seq FROM l WHERE k = 1 AND NOT gone AND value >= 80")
def stream_parked(spark, sf_dir):
    """Notes whose last change fails however often it is tried; all others are in the index."""
    feed, home = _files(spark, _changes(spark, sf_dir), "changes")
    upkeep.follow(feed.drop("event_id"), home, _letters_of_small, "letter string, place int", 16)
    return upkeep.parked(spark, home).select("path", "seq")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_late(spark, sf_dir):
    """Hourly windows that close behind a watermark, and the rows that came too late for them: together what a batch counts."""
    feed, home = _files(spark, table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "events")
    late.follow(feed, home, lambda: F.window("ts", "1 hour"), ["event_type"], "6 hours")
    columns = "start timestamp, end timestamp, event_type string, n long, total double"
    rows = late.closed(spark, home, columns).unionByName(late.still_open(spark, home, columns)).select("start", "event_type", "n", "total")
    missed = late.too_late(spark, home, "start timestamp, event_id long, ts timestamp, event_type string, value double")
    rows = rows.unionByName(missed.select("start", "event_type", F.lit(1).cast("long").alias("n"), F.col("value").alias("total")))
    return _plain_times(rows.groupBy("start", "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total")))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_sessions_late(spark, sf_dir):
    """Sessions of a user, parted by half an hour, that close behind a watermark, and late rows: together all of a user's rows."""
    feed, home = _files(spark, table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value"), "events")
    late.follow(feed, home, "30 minutes", ["user_id"], "6 hours", session=True)
    columns = "start timestamp, end timestamp, user_id long, n long, total double"
    rows = late.closed(spark, home, columns).unionByName(late.still_open(spark, home, columns)).select("user_id", "n", "total")
    missed = late.too_late(spark, home, "start timestamp, event_id long, ts timestamp, user_id long, value double")
    rows = rows.unionByName(missed.select("user_id", F.lit(1).cast("long").alias("n"), F.col("value").alias("total")))
    return rows.groupBy("user_id").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


def _edited(spark, sf_dir):
    """Every document's sentences as lines, before and after an edit that drops every seventh, changes every ninth and adds some."""
    said = F.split("text", r"(?<=\.)\s+")
    d = table(spark, sf_dir, "documents").select("doc_id", said.alias("s"))
    pick = lambda x, i: F.when(i % 7 == 3, F.array().cast("array<string>")).when(i % 9 == 5, F.array(F.upper(x))).when(i % 11 == 8, F.array(x, F.lit("a new line"))).otherwise(F.array(x))
    return d.select("doc_id", F.array_join("s", "\n").alias("before"), F.array_join(F.flatten(F.transform("s", pick)), "\n").alias("after"))


def set_line_diff(spark, sf_dir):
    """How many lines of each document stay, come and go in an edit. No SQL twin: the longest common subsequence is a table; a test compares with it."""
    ops = D.line_diffs(_edited(spark, sf_dir), "doc_id", "before", "after", fold=False)
    count = lambda kind: F.count(F.when(F.col("type") == kind, 1))
    return ops.groupBy("doc_id").agg(count("same").alias("same"), count("add").alias("added"), count("del").alias("gone"))


QUERIES["set_line_diff"] = set_line_diff


_MAIL = r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"


@query(f"""WITH d AS (SELECT doc_id AS id, list_sort(list_distinct(regexp_extract_all(text, '{_MAIL}'))) AS s FROM documents), c AS (SELECT s, min(id) AS class_id, count(*) AS n FROM d WHERE len(s) > 0 GROUP BY 1),
e AS (SELECT class_id, unnest(s) AS x FROM c), l AS (SELECT a.class_id, count(DISTINCT b.class_id) AS links FROM e a JOIN e b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY 1)
SELECT d.id AS doc_id, c.class_id, c.n, coalesce(links, 0) AS links FROM d JOIN c USING (s) LEFT JOIN l USING (class_id)""")
def join_shared_contacts(spark, sf_dir):
    """Documents by the addresses in them: a class for each set of these, and how many other classes share one."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0)).alias("addresses"))
    members, pairs = O.sharing_classes(d, "addresses")
    both = pairs.select(F.explode(F.array("left_id", "right_id")).alias("class_id"))
    links = both.groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(links, "class_id", "left").select(F.col("id").alias("doc_id"), "class_id", "n", F.coalesce("links", F.lit(0)).alias("links"))


_NAMED = r"""p AS (SELECT p_partkey AS id, p_size AS size, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN upper(p_brand || ' ' || p_type) ELSE p_brand || p_size END AS name FROM part),
n AS (SELECT size, regexp_replace(lower(name), '[^\p{L}\p{N}]', '', 'g') AS name, count(DISTINCT id) AS n, min(id) AS first FROM p GROUP BY 1, 2)"""


@query(f"WITH {_NAMED} SELECT a.size, a.name AS name_a, b.name AS name_b, a.n AS n_a, b.n AS n_b, a.first AS first_a, b.first AS first_b FROM n a JOIN n b ON a.size = b.size AND (CASE WHEN a.name = b.name THEN a.n > 1 ELSE length(a.name) >= 5 AND contains(b.name, a.name) END) WHERE a.name <> '' AND b.name <> ''")
def rec_audit_names(spark, sf_dir):
    """Parts of one size whose names are one, or lie in one another: the names of different parts are taken from different columns."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.col("p_type")).when(k == 2, F.upper(F.concat_ws(" ", "p_brand", "p_type"))).otherwise(F.concat("p_brand", F.col("p_size").cast("string")))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), name.alias("title"))
    return O.names_inside(p, ["size"], "title")


@query("""SELECT o_orderkey::VARCHAR AS id, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'issued' ELSE 'held' END AS state, o_orderstatus IN ('F', 'O') AS state_known, CASE WHEN o_orderkey % 10 <> 3 THEN round(o_totalprice, 2) END AS amount,
strftime(o_orderdate, '%Y-%m-%d') AS due, (o_orderkey % 10 = 3)::INT AS errors, (o_orderkey % 13 = 5 OR o_orderkey % 10 = 3) AS human_edited FROM orders WHERE o_orderkey % 17 <> 4 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey, o_orderdate, o_totalprice) = 1""")
def rec_typed(spark, sf_dir):
    """Orders written as notes of bills and read again: some amounts aren't numbers, some notes were edited, some aren't records."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min(F.struct("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")).alias("o")).select("o_orderkey", "o.*")
    key, none = F.col("o_orderkey"), F.lit(None)
    state = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "issued").otherwise("held")
    cell = {
        "path": F.concat(F.lit("Agent/Bills/"), key.cast("string"), F.lit(".md")), "id": key.cast("string"), "kind": F.lit("bill"), "title": F.concat(F.lit("Bill: no. "), key.cast("string")), "state": state, "body": F.lit("\nas it was\n"),
        "fields": F.create_map(F.lit("amount"), F.round("o_totalprice", 2).cast("string"), F.lit("due"), F.date_format("o_orderdate", "yyyy-MM-dd")),
    }
    records = o.select(*(cell.get(c.split()[0], none).cast(c.split(" ", 1)[1]).alias(c.split()[0]) for c in typed.RECORD.split(", ")))
    notes = typed.serialize_records(records)
    n = F.regexp_extract("path", "([0-9]+)[.]md$", 1).cast("long")
    text = F.when(n % 17 == 4, F.regexp_replace("content", "type: \"bill\"", "type: \"note\"")).when(n % 13 == 5, F.regexp_replace("content", "as it was", "as it is now")).otherwise(F.col("content"))
    text = F.when(n % 10 == 3, F.regexp_replace(text, "amount: [0-9.]+", "amount: unclear")).otherwise(text)
    rows = typed.parse_records(notes.select("path", text.alias("content")))
    return rows.select("id", "state", "state_known", F.col("fields")["amount"].cast("double").alias("amount"), F.col("fields")["due"].alias("due"), F.size("errors").alias("errors"), "human_edited")
