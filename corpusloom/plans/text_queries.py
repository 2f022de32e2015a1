"""Text functions and rules over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import notes as N
from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.operators import chunks as C
from corpusloom.operators import similarity as S
from corpusloom.plans.notes import notes
from corpusloom.sources import vault
from corpusloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


FLAT = r"trim(regexp_replace({}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(rf"""SELECT doc_id, CASE WHEN length(f) > 160 THEN rtrim(substr(f, 1, 159)) || '…' ELSE f END AS snippet
FROM (SELECT doc_id, {FLAT.format('text')} AS f FROM documents)""")
def text_snippet(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(r"""SELECT conv_id, turn, CASE WHEN a > 0 THEN '…' ELSE '' END || trim(substr(f, a + 1, 260)) || CASE WHEN length(f) > a + 260 THEN '…' ELSE '' END AS snippet
FROM (SELECT *, greatest(instr(lower(f), 'tion') - 101, 0) AS a FROM (SELECT conv_id, turn, regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g') AS f FROM conversations))""")
def text_snippet_around(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.snippet_around(F.col("text"), "tion").alias("snippet"))


_WORDS = r"""w AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}'']{3,}') AS t FROM documents))"""


@query(rf"""WITH {_WORDS}, d AS (SELECT doc_id, w, min(i) AS i FROM w WHERE w NOT IN ({', '.join(repr(x) for x in T.CONTEXT_STOP)}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, i) AS k FROM d)
SELECT doc_id, coalesce(terms, '') AS terms FROM documents LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS terms FROM r WHERE k <= 16 GROUP BY 1) USING (doc_id)""")
def text_context_terms(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.context_terms(F.col("text")).alias("terms"))


_SETS = rf"""{_WORDS}, s AS (SELECT doc_id, list(DISTINCT w ORDER BY w) AS s FROM w WHERE w NOT IN ({', '.join(repr(x) for x in T.KEY_STOP)}) GROUP BY 1),
k AS (SELECT doc_id, text, source, coalesce(s, []) AS s FROM documents LEFT JOIN s USING (doc_id))"""


@query(rf"""WITH {_SETS} SELECT doc_id, md5(source || '/' || doc_id || '.md::' || CASE WHEN len(s) = 0 AND length(b) > 0 THEN substr(b, 1, 60) ELSE array_to_string(s, ',') END) AS word_key
FROM (SELECT *, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS b FROM k)""")
def text_word_key(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", F.md5(T.word_key(F.col("path"), F.col("content"))).alias("word_key"))


@query(rf"""WITH {_SETS} SELECT a.doc_id, round(CASE WHEN a.s = b.s THEN 1.0 WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0
ELSE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END + 1e-9, 6) AS similarity FROM k a JOIN k b ON b.doc_id = a.doc_id + 1""")
def text_jaccard(spark, sf_dir):
    s = docs(spark, sf_dir).select("doc_id", T.word_set(F.col("text")).alias("s"))
    after = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return s.join(after, "doc_id").select("doc_id", F.round(T.set_similarity(F.col("s"), F.col("t")) + 1e-9, 6).alias("similarity"))


@query(r"""WITH l AS (SELECT doc_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS t FROM documents)),
c AS (SELECT doc_id, i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(x, '[\t\r]', ' ', 'g')), '^#{1,6}\s+', ''), '[*_`>#]', '', 'g'), '[\\/:*?"<>|#^\[\]]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS x FROM l),
f AS (SELECT doc_id, arg_min(x, i) AS x FROM c WHERE length(x) >= 3 AND NOT regexp_matches(lower(x), '^untitled( [0-9]+)?$') GROUP BY 1),
p AS (SELECT *, CASE WHEN contains(substr(x, 1, 61), ' ') THEN 61 - instr(reverse(substr(x, 1, 61)), ' ') ELSE 0 END AS p FROM f)
SELECT doc_id, CASE WHEN x IS NULL OR length(x) <= 60 THEN x WHEN p > 20 THEN substr(x, 1, p) ELSE substr(x, 1, 60) END AS title FROM documents LEFT JOIN p USING (doc_id)""")
def text_title(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.title_from_content(F.col("text")).alias("title"))


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[\\/:*?"<>|#^\[\]]', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), ''), 'Untitled') AS title FROM pages""")
def text_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sanitize_title(F.col("url")).alias("title"))


@query(rf"""WITH f AS (SELECT doc_id, {FLAT.format('text')} AS f FROM documents), s AS (SELECT doc_id, coalesce(nullif(regexp_extract(f || ' ', '^(.*?[.!?…。！？])\s', 1), ''), f) AS s FROM f),
p AS (SELECT *, CASE WHEN contains(substr(s, 1, 110), ' ') THEN 110 - instr(reverse(substr(s, 1, 110)), ' ') ELSE 0 END AS p FROM s)
SELECT doc_id, CASE WHEN length(s) <= 110 THEN s WHEN p > 30 THEN substr(s, 1, p) || '…' ELSE substr(s, 1, 109) || '…' END AS sentence FROM p""")
def text_first_sentence(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))


@query(rf"""SELECT page_id, {FLAT.format("replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&quot;', chr(34)), '&amp;', '&'), '&#39;', chr(39)), '&#039;', chr(39)), '&nbsp;', ' ')")} AS plain FROM pages""")
def text_html_plain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_plain(F.col("html")).alias("plain"))


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS n FROM h GROUP BY 1, 2""")
def text_links(spark, sf_dir):
    from corpusloom.plans.notes import links

    return links(spark, sf_dir).toDF("page_id", "target", "n")


def text_times(spark, sf_dir):
    """Clock times and amounts of every text; texts without either are left out."""
    rows = docs(spark, sf_dir).select("doc_id", T.times_in(F.col("text")).alias("times"), T.amounts_in(F.col("text")).alias("amounts"))
    return rows.where("size(times) + size(amounts) > 0").select("doc_id", F.array_join("times", ",").alias("times"), F.size("amounts").alias("amounts"))


QUERIES["text_times"] = text_times


@query(r"""WITH p AS (SELECT doc_id, source || '/' || doc_id || '.md' AS p FROM documents)
SELECT doc_id, h, h % 16 AS shard FROM (SELECT doc_id, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(p) + 1), lambda i: ascii(substr(p, i, 1))::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS h FROM p)""")
def text_fnv_shard(spark, sf_dir):
    h = T.fnv1a(F.col("path"))
    return notes(spark, sf_dir).select("doc_id", h.alias("h")).select("doc_id", "h", (F.col("h") % 16).alias("shard"))


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\n')) AS p FROM documents), k AS (
SELECT doc_id, regexp_replace(p, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS b, regexp_matches(p, '^\s*([-*+]\s|[0-9]+[.)]\s|#{1,6}\s|\[.\]\s|- \[.\])') AS is_log FROM p)
SELECT doc_id, r AS reflective, g AS logged, CASE WHEN r > g THEN 'journal' ELSE 'daily' END AS kind FROM (
SELECT doc_id, count(*) FILTER (WHERE length(b) >= 100 AND NOT is_log AND regexp_matches(b, '[.!?…。！？]')) AS r, count(*) FILTER (WHERE is_log) AS g FROM k GROUP BY 1)""")
def text_paragraph_kind(spark, sf_dir):
    p = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    is_log, good = T.is_log_line(F.col("p")), T.is_reflective(F.col("p"))
    n = p.groupBy("doc_id").agg(F.sum(good.cast("long")).alias("reflective"), F.sum(is_log.cast("long")).alias("logged"))
    return n.withColumn("kind", F.when(F.col("reflective") > F.col("logged"), "journal").otherwise("daily"))


@query(r"""WITH RECURSIVE c AS (SELECT doc_id, 0 AS k, NULL::VARCHAR AS piece, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS rest FROM documents UNION ALL
SELECT doc_id, k + 1, CASE WHEN length(rest) <= 1000 THEN rest ELSE regexp_replace(substr(rest, 1, cut_at), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') END,
CASE WHEN length(rest) <= 1000 THEN '' ELSE regexp_replace(substr(rest, cut_at + 1), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') END
FROM (SELECT *, CASE WHEN instr(reverse(substr(rest, 1, 1001)), ' ') BETWEEN 1 AND 1000 THEN 1001 - instr(reverse(substr(rest, 1, 1001)), ' ') ELSE 1000 END AS cut_at FROM c) WHERE rest <> '')
SELECT doc_id, k - 1 AS ordinal, length(piece) AS n_chars, md5(piece) AS piece FROM c WHERE k > 0""")
def text_chunk_hard(spark, sf_dir):
    split = F.pandas_udf(lambda s: s.map(lambda t: C.hard_split(t or "")), "array<string>")
    p = docs(spark, sf_dir).select("doc_id", F.posexplode(split("text")).alias("ordinal", "p"))
    return p.select("doc_id", "ordinal", F.length("p").alias("n_chars"), F.md5("p").alias("piece"))


def text_chunk_notes(spark, sf_dir):
    """Markdown chunks of all notes."""
    c = C.chunks(notes(spark, sf_dir))
    return c.select("id", "path", "ordinal", "heading", F.length("text").alias("n_chars"))


QUERIES["text_chunk_notes"] = text_chunk_notes

_NETS = " || ".join(f"""CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])({net.replace("'", "''")})([^a-z0-9_]|$)') THEN ['{flag}'] ELSE [] END""" for net, flag in P.PERSONAL)


@query(f"SELECT doc_id, array_to_string({_NETS}, '; ') AS flags FROM documents")
def pred_personal(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(P.personal_flags(F.col("text")), "; ").alias("flags"))


_COUNT = rf"(CASE WHEN {FLAT.format('text')} = '' THEN 0 ELSE len(string_split({FLAT.format('text')}, ' ')) END)"
_TASKS = r"(regexp_matches(text, '(?m)^\s*- \[ \]') OR regexp_matches(text, '(^|[^A-Za-z0-9_])TODO([^A-Za-z0-9_]|$)'))"


@query(rf"""SELECT doc_id, array_to_string(list_filter([CASE WHEN {_TASKS} THEN 'open tasks / TODO markers' END, CASE WHEN {_COUNT} < 40 THEN 'stub — under 40 words' END], lambda x: x IS NOT NULL), '; ') AS problems FROM documents""")
def pred_polish(spark, sf_dir):
    none = F.array().cast("array<string>")
    return docs(spark, sf_dir).select("doc_id", F.array_join(P.polish_problems(F.col("text"), none, F.lit(0)), "; ").alias("problems"))


@query(rf"""SELECT doc_id, CASE WHEN {_COUNT} < 40 THEN 3 WHEN {_COUNT} < 120 THEN 1 ELSE 0 END + {_TASKS}::INT AS score FROM documents""")
def pred_incomplete(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", P.incompleteness(F.col("text"), F.lit(0)).alias("score"))


_PERIODIC = " OR ".join(f"regexp_matches(lower(b), '{s}')" for s in P.PERIODIC)
_NAMES = """n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 2 THEN strftime(o_orderdate, '%-d %B %Y')
WHEN 3 THEN strftime(o_orderdate, '%Y-%m') ELSE 'order ' || o_orderkey END AS b FROM orders)"""


def _names(spark, sf_dir):
    """Orders under names of several styles."""
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    name = F.when(k == 0, P.date_name(at, "iso")).when(k == 1, P.date_name(at, "written")).when(k == 2, P.date_name(at, "day-first")).when(k == 3, F.date_format(at, "yyyy-MM")).otherwise(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("journal/"), name, F.lit(".md")).alias("path"))


@query(f"WITH {_NAMES} SELECT o_orderkey, {_PERIODIC} AS periodic FROM n")
def pred_periodic(spark, sf_dir):
    return _names(spark, sf_dir).select("o_orderkey", P.looks_periodic(F.col("path")).alias("periodic"))


@query(f"WITH {_NAMES} SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%m-%d') END AS day_key FROM n JOIN orders USING (o_orderkey)")
def pred_day_key(spark, sf_dir):
    return _names(spark, sf_dir).select("o_orderkey", P.day_key(F.col("path")).alias("day_key"))


@query(f"""WITH {_NAMES}, s AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'iso' WHEN o_orderkey % 5 = 1 THEN 'written' WHEN o_orderkey % 5 = 2 THEN 'day-first' END AS style FROM n)
SELECT style, count(*) AS n FROM s WHERE style IS NOT NULL GROUP BY 1 ORDER BY n DESC, CASE style WHEN 'iso' THEN 0 WHEN 'iso-weekday' THEN 1 WHEN 'written' THEN 2 ELSE 3 END LIMIT 1""")
def agg_mode_format(spark, sf_dir):
    styles = F.array(*map(F.lit, ("iso", "iso-weekday", "written", "day-first")))
    n = _names(spark, sf_dir).select(P.date_style(F.col("path")).alias("style")).where("style is not null").groupBy("style").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), F.array_position(styles, F.col("style"))).limit(1)


@query("""SELECT level, client, count(*) AS notes FROM (SELECT CASE WHEN source IN ('src1', 'src2') THEN 2 WHEN source IN ('src3') OR toxic = 1 THEN 1 ELSE 0 END AS level FROM documents LEFT JOIN labels USING (doc_id)),
(VALUES ('local'), ('remote')) c(client) WHERE level = 0 OR (level = 1 AND client = 'local') GROUP BY 1, 2""")
def pred_privacy_level(spark, sf_dir):
    marked = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    level = F.greatest(P.privacy_level(F.col("path"), ["src1", "src2"], ["src3"]), F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)))
    rows = notes(spark, sf_dir).join(marked, "doc_id", "left").select(level.alias("level"), F.explode(F.array(F.lit("local"), F.lit("remote"))).alias("client"))
    seen = F.when(F.col("client") == "local", P.allowed(F.col("level"), "local")).otherwise(P.allowed(F.col("level"), "remote"))
    return rows.where(seen).groupBy("level", "client").agg(F.count("*").alias("notes"))


@query("SELECT doc_id FROM documents WHERE NOT (source = 'src4' OR source = 'src5' OR regexp_matches(source || '/' || doc_id || '.md', '7\\.md$'))")
def pred_excluded(spark, sf_dir):
    return notes(spark, sf_dir).where(~P.excluded(F.col("path"), ["src4", "src5"], (r"7\.md$",))).select("doc_id")


@query("""SELECT d.doc_id, coalesce(quality = 1, false) AS published, d.source NOT IN ('src1', 'src2', 'src3') AND coalesce(toxic, 0) = 0 AS candidate FROM documents d LEFT JOIN labels l USING (doc_id)""")
def pred_publish_candidate(spark, sf_dir):
    rows = notes(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    private = P.excluded(F.col("path"), ["src1", "src2", "src3"])
    return rows.select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("published"), (~private & (F.coalesce("toxic", F.lit(0)) == 0)).alias("candidate"))


@query(r"""WITH b AS (SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '[#>*\-_`\[\]|]', '', 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'))) AS n FROM documents), v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
t AS (SELECT a.doc_id, max(round(list_cosine_similarity(a.v, b.v), 6)) AS cosine FROM v a JOIN v b ON a.doc_id <> b.doc_id GROUP BY 1)
SELECT doc_id, CASE WHEN n < 40 THEN 'archive' WHEN cosine >= 0.45 THEN 'merge' ELSE 'elaborate' END AS disposition FROM b LEFT JOIN t USING (doc_id)""")
def pred_triage(spark, sf_dir):
    """What to do with each note, all of an inbox, against all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    best = S.top(S.cosines(v, v, -1.0, 1), 1).select(F.col("query_id").alias("doc_id"), "cosine")
    return docs(spark, sf_dir).join(best, "doc_id", "left").select("doc_id", N.triage(F.col("text"), F.col("cosine"), 0.45).alias("disposition"))


@query("""SELECT o_orderkey, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d <= 6 THEN strftime(day, '%A') ELSE d || ' days ago' END AS label FROM (SELECT o_orderkey, o_orderdate::DATE AS day, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS d FROM orders)""")
def text_continuity(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.continuity(F.col("o_orderdate").cast("date"), F.lit("1998-08-02").cast("date")).alias("label"))


@query(r"""SELECT conv_id, md5(string_agg('**' || role || ':** ' || text, chr(10) || chr(10) ORDER BY turn, role, text)) AS note, count(*) AS turns FROM conversations GROUP BY 1""")
def sink_transcripts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    n = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return vault.transcripts(turns).join(n, "conv_id").select("conv_id", F.md5("note").alias("note"), "turns")


def text_paragraphs(spark, sf_dir):
    """Paragraphs, segments and the last reflective gist of every note."""
    c = F.col("content")
    return notes(spark, sf_dir).select("doc_id", F.size(N.paragraphs(c)).alias("paragraphs"), F.size(N.segments(c)).alias("segments"), N.last_reflective(c).alias("gist"), F.md5(N.inert_quote(c)).alias("quote"))


QUERIES["text_paragraphs"] = text_paragraphs
