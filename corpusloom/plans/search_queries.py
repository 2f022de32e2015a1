"""Retrieval: lexical, vector, and both fused. Queries are all items of benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import notes as N
from corpusloom.functions import predicates as P
from corpusloom.functions import text as T
from corpusloom.operators import chunks as C
from corpusloom.operators import fielded as D
from corpusloom.operators import lexical as L
from corpusloom.operators import ranking as R
from corpusloom.operators import similarity as S
from corpusloom.plans.notes import notes
from corpusloom.sources.lineage import cut
from corpusloom.sources.tables import table

QUERIES, ORACLES = {}, {}
#: The floor under which hashed bags of words don't count as near.
FLOOR = 0.3
TODAY = "2027-01-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _index(spark, sf_dir):
    return L.postings(table(spark, sf_dir, "documents"), {"text": 1.0})


def _asked(spark, sf_dir):
    """Context terms of every benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split(T.context_terms(F.col("text")), " ")).alias("term"))
    return items.where("term <> ''")


_STOP = ", ".join(repr(x) for x in T.CONTEXT_STOP)
_POST = r"""t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
p AS (SELECT id, term, count(*)::DOUBLE AS tf FROM t GROUP BY 1, 2), pl AS (SELECT *, sum(tf) OVER (PARTITION BY id) AS len FROM p),
st AS (SELECT count(*) AS docs, avg(len) AS mean FROM (SELECT DISTINCT id, len FROM pl))"""
_ASKED = rf"""bw AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}'']{{3,}}') AS t FROM benchmark)),
bd AS (SELECT item_id, w, min(i) AS i FROM bw WHERE w NOT IN ({_STOP}) GROUP BY 1, 2),
a AS (SELECT item_id AS query_id, w AS term, w AS asked FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, i) AS k FROM bd) WHERE k <= 16)"""
_BM = """df AS (SELECT term, count(*) AS df FROM pl WHERE term IN (SELECT term FROM a) GROUP BY 1),
sc AS (SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score, count(DISTINCT asked) AS met
FROM pl JOIN (SELECT DISTINCT query_id, term, asked FROM a) a USING (term) JOIN df USING (term), st GROUP BY 1, 2)"""


@query(rf"WITH {_POST} SELECT id, term, tf, len FROM pl")
def lex_postings(spark, sf_dir):
    return _index(spark, sf_dir)


@query(rf"WITH {_POST}, {_ASKED}, {_BM} SELECT query_id, id, score, k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM sc) WHERE k <= 50")
def lex_bm25_or(spark, sf_dir):
    return L.search(table(spark, sf_dir, "documents"), {"text": 1.0}, _asked(spark, sf_dir), 50)


_NEEDED = "n AS (SELECT query_id, count(DISTINCT asked) AS needed FROM a GROUP BY 1)"


@query(rf"""WITH {_POST}, {_ASKED}, {_BM}, {_NEEDED}
SELECT query_id, id, score, k - 1 AS rank FROM (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM sc JOIN n USING (query_id) WHERE met = needed) WHERE k <= 50""")
def lex_bm25_and(spark, sf_dir):
    """All context terms of an item must be met."""
    return L.search(table(spark, sf_dir, "documents"), {"text": 1.0}, _asked(spark, sf_dir), 50, every=True)


def _all_met(docs, fields, asked, share, k):
    """All asked terms met, each by what stands for it: first the vocabulary is searched, then only what stands for a term is counted."""
    terms = cut(L.expanded(L.vocabulary(docs, fields), asked, share))
    return L.search(docs, fields, terms, k, every=True)


def lex_bm25_expanded(spark, sf_dir):
    """All terms met, each exactly, as a prefix or within the edit distance."""
    return _all_met(table(spark, sf_dir, "documents"), {"text": 1.0}, _asked(spark, sf_dir), 0.2, 50)


QUERIES["lex_bm25_expanded"] = lex_bm25_expanded


def lex_fuzzy_vocab(spark, sf_dir):
    """No SQL twin: DuckDB's edit distance counts bytes. A test compares with brute force."""
    return L.fuzzy(_index(spark, sf_dir), _asked(spark, sf_dir))


QUERIES["lex_fuzzy_vocab"] = lex_fuzzy_vocab


@query(rf"""WITH {_POST.split(',' + chr(10) + 'p AS')[0]}, {_ASKED}, v AS (SELECT DISTINCT term FROM t) SELECT query_id, asked, v.term FROM (SELECT DISTINCT query_id, asked FROM a) a, v WHERE starts_with(v.term, asked)""")
def lex_prefix_vocab(spark, sf_dir):
    return L.prefixed(_index(spark, sf_dir), _asked(spark, sf_dir))


_WIDE = "w AS (SELECT DISTINCT query_id, v.term, asked FROM (SELECT DISTINCT query_id, asked FROM a0) a0 JOIN (SELECT DISTINCT term FROM pl) v ON starts_with(v.term, asked)), a AS (SELECT * FROM w)"


@query(rf"""WITH {_POST}, {_ASKED.replace('a AS (SELECT item_id', 'a0 AS (SELECT item_id')}, {_WIDE}, {_BM}, n AS (SELECT query_id, count(DISTINCT asked) AS needed FROM a0 GROUP BY 1)
SELECT query_id, id, score, k - 1 AS rank FROM (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM sc JOIN n USING (query_id) WHERE met = needed) WHERE k <= 50""")
def lex_prefix_and(spark, sf_dir):
    """All terms met, each exactly or as a prefix."""
    return _all_met(table(spark, sf_dir, "documents"), {"text": 1.0}, _asked(spark, sf_dir), None, 50)


def lex_gateway(spark, sf_dir):
    """An index of whole notes, titles counting three times: all terms met, each exactly, as a
    prefix or within an edit distance of 0.15 of its length; sealed notes never show. No SQL
    twin: DuckDB's edit distance counts bytes. A test compares with brute force."""
    sealed = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    d = table(spark, sf_dir, "documents").join(sealed, "doc_id", "left_anti").select("doc_id", F.substring("text", 1, 60).alias("title"), "text")
    return _all_met(d, {"title": 3.0, "text": 1.0}, _asked(spark, sf_dir), 0.15, 25)


QUERIES["lex_gateway"] = lex_gateway


@query(r"""WITH t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), c AS (SELECT id, w, count(*) AS n FROM t GROUP BY 1, 2),
h AS (SELECT w, (list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(w) + 1), lambda i: ascii(substr(w, i, 1))::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 256)::INT AS bucket FROM (SELECT DISTINCT w FROM t))
SELECT id, bucket, sum(n)::BIGINT AS n FROM c JOIN h USING (w) GROUP BY 1, 2""")
def vec_hash_embed(spark, sf_dir):
    return S.hash_embedding(table(spark, sf_dir, "documents"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_COS = "round(list_cosine_similarity(a.v, b.v), 6)"


@query(f"WITH {_V} SELECT id, round(list_aggregate(list_transform(v, lambda x: abs(x)), 'max') / nullif(sqrt(list_dot_product(v, v)), 0), 6) AS greatest FROM v")
def vec_normalize(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", S.unit(F.col("v")).alias("u"))
    return v.select("id", F.round(F.array_max(F.transform("u", F.abs)), 6).alias("greatest"))


@query(f"""WITH {_V}, s AS (SELECT id, v, list_aggregate(list_transform(v, lambda x: abs(x)), 'max') AS m FROM v), z AS (SELECT *, CASE WHEN m > 0 THEN m / 127 ELSE 1.0 END AS s FROM s)
SELECT id, round(s, 9) AS scale, list_sum(list_transform(v, lambda x: floor(x / s + 0.5)))::BIGINT AS total FROM z""")
def vec_quantize(spark, sf_dir):
    q = _vectors(spark, sf_dir).select("id", S.quantized(F.col("v")).alias("q"))
    return q.select("id", F.round("q.scale", 9).alias("scale"), F.aggregate("q.data", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def _near(spark, sf_dir, floor=-1.0, k=None):
    v = _vectors(spark, sf_dir)
    return S.cosines(v.where("id % 20 = 0"), v, floor, k)


_PAIRS = f"{_V}, c AS (SELECT a.id AS query_id, b.id, b.label, {_COS} AS cosine FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 20 = 0)"


@query(f"WITH {_PAIRS} SELECT query_id, id, cosine, k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS k FROM c WHERE cosine >= 0.1) WHERE k <= 10")
def vec_topk(spark, sf_dir):
    return S.top(_near(spark, sf_dir, 0.1, 10), 10)


@query(f"WITH {_V} SELECT a.id AS query_id, b.id, {_COS} AS cosine FROM v a JOIN v b ON a.id < b.id WHERE {_COS} >= 0.3")
def vec_floor_join(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return S.cosines(v, v, FLOOR, below=True)


@query(f"WITH {_PAIRS} SELECT query_id, label, max(cosine) AS cosine FROM c GROUP BY 1, 2")
def vec_max_per_note(spark, sf_dir):
    """The best cosine of each query with every note (label), whose chunks the vectors are."""
    v = _vectors(spark, sf_dir).withColumnRenamed("label", "grp")
    return S.best_by_group(v.where("id % 20 = 0"), v).withColumnRenamed("grp", "label")


_CAL = f"CASE WHEN cosine <= {R.KNOTS[0][0]} THEN cosine + ({R.KNOTS[0][1]} - {R.KNOTS[0][0]}) " + f"WHEN cosine >= {R.KNOTS[-1][0]} THEN least(1, cosine + ({R.KNOTS[-1][1]} - {R.KNOTS[-1][0]})) " + " ".join(f"WHEN cosine <= {b} THEN {c} + (cosine - {a}) / ({b} - {a})::DOUBLE * ({d} - {c})" for (a, c), (b, d) in zip(R.KNOTS, R.KNOTS[1:], strict=False)) + " END"


@query(f"WITH {_PAIRS} SELECT query_id, id, round({_CAL}, 6) AS scaled FROM c WHERE cosine >= 0.3")
def vec_calibrate(spark, sf_dir):
    return _near(spark, sf_dir, FLOOR).select("query_id", "id", F.round(R.calibrated(F.col("cosine")), 6).alias("scaled"))


@query(f"WITH {_PAIRS} SELECT query_id, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS k FROM c) WHERE k <= 3 AND cosine >= 0.35")
def vec_near_dup(spark, sf_dir):
    return S.top(_near(spark, sf_dir, -1.0, 3), 3).where("cosine >= 0.35").select("query_id", "id", "cosine")


@query(f"""WITH {_V}, c AS (SELECT {_COS} AS cosine FROM v a JOIN v b ON a.id < b.id), q AS (SELECT quantile_cont(cosine, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM c) SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS p, round(unnest(q), 6) AS cosine FROM q""")
def vec_quantiles(spark, sf_dir):
    """Exact quantiles of the cosines of all pairs of vectors."""
    ps = (0.05, 0.25, 0.5, 0.75, 0.95)
    q = S.cosine_counts(_vectors(spark, sf_dir)).agg(F.percentile("cosine", F.array(*map(F.lit, ps)), F.col("n")).alias("q"))
    return q.select(F.posexplode("q").alias("i", "c")).select(F.element_at(F.array(*map(F.lit, ps)), F.col("i") + 1).alias("p"), F.round("c", 6).alias("cosine"))


_LEG = f"{_PAIRS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS leg FROM c) WHERE leg <= 100)"


def _leg(spark, sf_dir):
    """The hundred candidates of a leg."""
    return S.top(_near(spark, sf_dir, -1.0, 100), 100).drop("rank")


@query(f"""WITH {_LEG}, x AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS k FROM l),
y AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id % 97, id) AS k FROM l), u AS (SELECT * FROM x WHERE k <= 20 UNION ALL SELECT * FROM y WHERE k <= 20)
SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + k)), 9) AS fused FROM u GROUP BY 1, 2""")
def fuse_rrf(spark, sf_dir):
    c = _leg(spark, sf_dir)
    x = S.top(c, 20).select(F.lit(0).alias("list_id"), "query_id", "id", "rank")
    y = S.top(c.withColumn("s", -(F.col("id") % 97)), 20, "s").select(F.lit(1).alias("list_id"), "query_id", "id", "rank")
    return R.rrf(x.unionByName(y), by=("query_id",)).select("query_id", "id", F.round("fused", 9).alias("fused"))


@query(f"WITH {_LEG} SELECT query_id, label, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY cosine DESC, id) AS k FROM l) WHERE k = 1")
def fuse_collapse(spark, sf_dir):
    c = _leg(spark, sf_dir).join(_vectors(spark, sf_dir).select("id", "label"), "id")
    return R.collapse(c, "label", "cosine", by=("query_id",)).select("query_id", "label", "id", "cosine")


@query(f"WITH {_LEG} SELECT query_id, id, k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (label % 2 = 0)::INT, cosine DESC, id) AS k FROM l) WHERE k <= 20")
def fuse_sink(spark, sf_dir):
    c = _leg(spark, sf_dir).join(_vectors(spark, sf_dir).select("id", "label"), "id")
    return R.sunk(c, F.col("label") % 2 == 0, "cosine", "id", 20, ("query_id",)).select("query_id", "id", "rank")


_CONF = """b AS (SELECT *, 1.0::DOUBLE / k AS s0 FROM r), s1 AS (SELECT *, s0 + (1 - s0) * 0.35 * least(1, greatest(0, (2 * cosine - 0.55) / 0.3)) AS s1 FROM b), s2 AS (SELECT *, least(1, s1 + (1 - s1) * 0.15 * (label = 3)::INT) AS s2 FROM s1)"""


@query(f"""WITH {_PAIRS}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS k FROM c) WHERE k <= 20), {_CONF}
SELECT query_id, id, round(s2 + 1e-9, 4) AS confidence, CASE WHEN s2 >= 0.6 THEN 'prominent' WHEN s2 >= 0.3 THEN 'quiet' ELSE 'faint' END AS prominence FROM s2""")
def fuse_confidence(spark, sf_dir):
    c = S.top(_near(spark, sf_dir, -1.0, 20), 20).join(_vectors(spark, sf_dir).select("id", "label"), "id")
    s = R.confidence(F.col("rank"), F.col("cosine") * 2, (F.col("label") == 3).cast("double"))
    return c.select("query_id", "id", F.round(s + 1e-9, 4).alias("confidence"), R.prominence(s).alias("prominence"))


@query(f"""SELECT doc_id, round(least(1, log2(1 + doc_id % 20) / 4), 6) AS linked, round(pow(0.5, greatest(0, date_diff('hour', TIMESTAMP '2024-01-01' + to_hours(doc_id), TIMESTAMP '{TODAY}')) / 24.0 / 30), 6) AS recency,
round(least(1, 3.0 / greatest(1, ceil(length(text) / 1000.0))), 6) AS atomicity FROM documents""")
def fuse_signals(spark, sf_dir):
    age = (F.unix_timestamp(F.lit(TODAY).cast("timestamp")) - F.unix_timestamp("mtime")) / 86400.0
    return notes(spark, sf_dir).select(
        "doc_id",
        F.round(R.linked_signal(F.col("doc_id") % 20), 6).alias("linked"),
        F.round(R.recency_signal(age), 6).alias("recency"),
        F.round(R.atomicity_signal(F.ceil(F.length("content") / 1000.0)), 6).alias("atomicity"),
    )


def hybrid(spark, sf_dir, keep=None, chunked=False, k=20, legs=100):
    """All benchmark items against the documents: BM25 and hashed vectors, fused, best chunk of
    each note, with confidence. ``keep`` filters notes before either leg ranks."""
    n = notes(spark, sf_dir)
    if keep is not None:
        n = n.where(keep)
    units = C.chunks(n).select("path", "text", F.xxhash64("id").alias("doc_id")) if chunked else n.select("path", F.col("content").alias("text"), "doc_id")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    lexical = L.search(units, {"text": 1.0}, _asked(spark, sf_dir), legs).select(F.lit(0).alias("list_id"), "query_id", "id", "rank")
    q, x = (S.hash_vectors(d) for d in (items, units))
    vector = S.top(S.cosines(q.select((-1 - F.col("id")).alias("id"), "v"), x, FLOOR, legs), legs).withColumn("query_id", -1 - F.col("query_id"))
    fused = R.rrf(lexical.unionByName(vector.select(F.lit(1).alias("list_id"), "query_id", "id", "rank")), by=("query_id",)).withColumn("fused", F.round("fused", 9))
    best = R.collapse(fused.join(units.select(F.col("doc_id").alias("id"), "path"), "id"), "path", by=("query_id",))
    ranked = R.sunk(best, F.lit(False), "fused", "id", k, ("query_id",))
    out = ranked.join(vector.select("query_id", "id", "cosine"), ["query_id", "id"], "left").join(lexical.select("query_id", "id", F.lit(True).alias("lexical")), ["query_id", "id"], "left")
    score = R.confidence(F.col("rank"), F.col("cosine"))
    return out.select("query_id", "path", "rank", "fused", F.col("cosine").alias("cosine"), F.round(score + 1e-9, 4).alias("confidence"), R.prominence(score).alias("prominence"), F.col("lexical").isNull().alias("semantic_only"))


def _hybrid_sql(where: str = "TRUE") -> str:
    docs = f"documents AS (SELECT * FROM main.documents WHERE {where})"
    emb = lambda name, table, key: rf"""{name}t AS (SELECT {key} AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {table}), {name}c AS (SELECT id, w, count(*) AS n FROM {name}t GROUP BY 1, 2),
{name}h AS (SELECT w, (list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(w) + 1), lambda i: ascii(substr(w, i, 1))::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 256)::INT AS bucket FROM (SELECT DISTINCT w FROM {name}t)),
{name}s AS (SELECT id, bucket, sum(n)::DOUBLE AS n FROM {name}c JOIN {name}h USING (w) GROUP BY 1, 2), {name} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS n FROM {name}s)"""  # noqa: E731
    return rf"""WITH {docs}, {_POST}, {_ASKED}, {_BM}, lx AS (SELECT query_id, id, k FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM sc) WHERE k <= 100),
{emb('q', 'benchmark', 'item_id')}, {emb('x', 'documents', 'doc_id')}, cs AS (SELECT q.id AS query_id, x.id, round(sum(q.n * x.n), 6) AS cosine FROM q JOIN x USING (bucket) GROUP BY 1, 2),
vx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS k FROM cs WHERE cosine >= 0.3) WHERE k <= 100),
fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + k)), 9) AS fused FROM (SELECT query_id, id, k FROM lx UNION ALL SELECT query_id, id, k FROM vx) GROUP BY 1, 2),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS k FROM fu) WHERE k <= 20),
b AS (SELECT rk.query_id, rk.id, rk.k, fused, cosine, lx.id IS NULL AS semantic_only, 1.0::DOUBLE / rk.k AS s0 FROM rk LEFT JOIN vx ON vx.query_id = rk.query_id AND vx.id = rk.id LEFT JOIN lx ON lx.query_id = rk.query_id AND lx.id = rk.id),
z AS (SELECT *, s0 + (1 - s0) * 0.35 * coalesce(least(1, greatest(0, (cosine - 0.55) / 0.3)), 0) AS s FROM b)
SELECT query_id, source || '/' || id || '.md' AS path, k - 1 AS rank, fused, cosine, round(s + 1e-9, 4) AS confidence, CASE WHEN s >= 0.6 THEN 'prominent' WHEN s >= 0.3 THEN 'quiet' ELSE 'faint' END AS prominence, semantic_only FROM z JOIN documents ON doc_id = id"""


@query(_hybrid_sql())
def search_hybrid(spark, sf_dir):
    return hybrid(spark, sf_dir)


@query(_hybrid_sql("contains(lower(source), 'src1') AND lang = 'en' AND TIMESTAMP '2024-01-01' + to_hours(doc_id) >= TIMESTAMP '2024-01-02'"))
def search_scoped(spark, sf_dir):
    return hybrid(spark, sf_dir, P.passes(F.col("folder"), F.col("type"), F.col("mtime"), "SRC1", "en", "2024-01-02"))


@query(f"""WITH {_V}, n AS (SELECT a.label AS note, b.label AS other, max({_COS}) AS cosine FROM v a JOIN v b ON a.label <> b.label GROUP BY 1, 2)
SELECT note, other, cosine, k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY note ORDER BY (other % 2)::INT, cosine DESC, other) AS k FROM n) WHERE k <= 8""")
def search_related_path(spark, sf_dir):
    """The eight notes nearest each note by the best cosine of any two of their chunks; odd ones sink."""
    v = _vectors(spark, sf_dir).withColumnRenamed("label", "grp")
    best = S.best_by_group(v, v).join(v.select(F.col("id").alias("query_id"), F.col("grp").alias("note")), "query_id").where("note <> grp")
    best = best.groupBy("note", F.col("grp").alias("other")).agg(F.max("cosine").alias("cosine"))
    return R.sunk(best, F.col("other") % 2, "cosine", "other", 8, ("note",)).select("note", "other", "cosine", "rank")


@query(f"""WITH {_PAIRS} SELECT query_id, id, CASE WHEN cosine >= 0.4 AND label <> 1 THEN 'echo' WHEN cosine >= 0.3 AND cosine < 0.4 THEN 'candidate' END AS band, round(0.5 + 0.4 * least(1, greatest(0, (cosine - 0.4) / 0.6)), 6) AS confidence
FROM c WHERE cosine >= 0.3 AND NOT (cosine >= 0.4 AND label = 1)""")
def search_bands(spark, sf_dir):
    c = _near(spark, sf_dir, FLOOR).join(_vectors(spark, sf_dir).select("id", "label"), "id")
    rows = c.withColumn("band", R.band(F.col("cosine"), FLOOR, 0.4, F.col("label") == 1)).where("band is not null")
    return rows.select("query_id", "id", "band", F.round(R.echo_confidence(F.col("cosine"), 0.4), 6).alias("confidence"))


@query(f"""WITH {_PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS k FROM c WHERE cosine >= 0.1), m AS (SELECT DISTINCT query_id FROM c),
s AS (SELECT query_id, vec_id AS id FROM m, embeddings WHERE label = 2 AND vec_id <> query_id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY k NULLS LAST, id) - 1 AS rank FROM s LEFT JOIN (SELECT * FROM t WHERE k <= 500) t USING (query_id, id)""")
def search_rerank_set(spark, sf_dir):
    """A given set (label 2) in the order of relatedness to each focus, the rest as it was."""
    v = _vectors(spark, sf_dir).select("id", "label")
    given = v.where("label = 2").select("id")
    ranked = S.top(_near(spark, sf_dir, 0.1, 500), 500).join(given, "id", "left_semi")
    return R.reordered(v.where("id % 20 = 0").select("id"), given, ranked)


def search_next_action(spark, sf_dir):
    """At most one hint for a note: merge with a near twin, or split a long one."""
    n = notes(spark, sf_dir)
    x = S.hash_vectors(n.select("doc_id", F.col("content").alias("text")))
    best = S.top(S.cosines(x.where("id % 20 = 0"), x, 0.95, 1), 1).select(F.col("query_id").alias("doc_id"), F.col("id").alias("twin"))
    heads = F.size(F.regexp_extract_all("content", F.lit(r"(?m)^##\s"), F.lit(0)))
    action = F.when(F.col("twin").isNotNull(), "merge").when((F.length("content") > 2500) & (heads < 2), "split")
    return n.where("doc_id % 20 = 0").join(best, "doc_id", "left").select("doc_id", action.alias("action"), "twin")


QUERIES["search_next_action"] = search_next_action


def _lines(spark, sf_dir):
    """A search line for each benchmark item: its two longest context terms, the first cut to six letters, with filters or a phrase."""
    words = F.slice(F.split(T.context_terms(F.col("text")), " "), 1, 2)
    first = F.substring(words[0], 1, 6)
    rest = F.array_join(F.slice(words, 2, 1), " ")
    k = F.col("item_id") % 4
    line = (
        F.when(k == 0, F.concat_ws(" ", first, rest))
        .when(k == 1, F.concat_ws(" ", F.lit("type:en"), first, rest))
        .when(k == 2, F.concat(first, F.lit(' "'), rest, F.lit('"')))
        .otherwise(F.concat_ws(" ", F.lit('in:"SRC1"'), first, F.lit("since:2024-01-02"), rest))
    )
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), line.alias("raw"))


def fielded(spark, sf_dir, k=20, share=None):
    """Search lines, parsed, over title, meta and text of notes; filters apply before anything is ranked."""
    n = notes(spark, sf_dir).select("doc_id", "title", F.concat_ws(" ", "type", "folder").alias("meta"), F.col("content").alias("text"), "folder", "type", "mtime")
    q = _lines(spark, sf_dir).select("query_id", N.parsed_query(F.col("raw")).alias("q")).select("query_id", "q.*")
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "text", F.array_join("phrases", " "))), F.lit(L.TOKEN), F.lit(0))
    asked = q.select("query_id", F.explode(F.array_distinct(words)).alias("term"))
    boosts = {f: D.BOOSTS[f] for f in ("title", "meta", "text")}
    terms = cut(D.weighted(D.vocabulary(n, list(boosts), "doc_id"), asked, share))
    filters = q.select("query_id", F.col("folder").alias("q_folder"), F.col("type").alias("q_type"), F.col("since").alias("q_since"))

    def keep(rows):
        met = rows.join(filters, "query_id").join(n.select(F.col("doc_id").alias("id"), "folder", "type", "mtime"), "id")
        return met.where(P.passes_each(F.col("folder"), F.col("type"), F.col("mtime"), F.col("q_folder"), F.col("q_type"), F.col("q_since"))).select(rows.columns)

    return D.search(n, terms, k, boosts, key="doc_id", keep=keep)


_FIELDED = rf"""f AS (SELECT doc_id AS id, 'title' AS field, 2.0::DOUBLE AS boost, lower(text[1:60]) AS t FROM documents UNION ALL SELECT doc_id, 'meta', 2.0, lower(concat_ws(' ', lang, source)) FROM documents UNION ALL SELECT doc_id, 'text', 1.0, lower(text) FROM documents),
tk AS (SELECT id, field, boost, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) AS term FROM f), p AS (SELECT id, field, boost, term, count(*)::DOUBLE AS tf FROM tk GROUP BY ALL),
pl AS (SELECT *, sum(tf) OVER (PARTITION BY id, field) AS len FROM p), st AS (SELECT field, count(*) AS docs, avg(len) AS mean FROM (SELECT DISTINCT id, field, len FROM pl) GROUP BY 1),
{_ASKED.replace("a AS (SELECT item_id AS query_id, w AS term, w AS asked FROM", "ct AS (SELECT item_id AS query_id, w, k FROM")},
aw AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(CASE WHEN k = 1 THEN w[1:6] ELSE w END, '[\p{{L}}\p{{N}}]+')) AS asked FROM ct WHERE k <= 2),
w AS (SELECT query_id, asked, term, max(weight) AS weight FROM (SELECT query_id, asked, asked AS term, 1.0::DOUBLE AS weight FROM aw
  UNION ALL SELECT query_id, asked, v.term, 0.375::DOUBLE * length(asked) / (length(asked) + 0.3::DOUBLE * (length(v.term) - length(asked))) FROM aw JOIN (SELECT DISTINCT term FROM pl) v ON starts_with(v.term, asked) AND v.term <> asked) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM pl WHERE term IN (SELECT term FROM w) GROUP BY 1, 2),
pt AS (SELECT query_id, id, field, sum(weight * boost * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score, list(DISTINCT asked) AS asked FROM pl JOIN w USING (term) JOIN df USING (field, term) JOIN st USING (field) GROUP BY ALL),
ok AS (SELECT pt.* FROM pt JOIN documents d ON d.doc_id = pt.id WHERE CASE query_id % 4 WHEN 1 THEN lang = 'en' WHEN 3 THEN contains(lower(source), 'src1') AND TIMESTAMP '2024-01-01' + to_hours(doc_id) >= TIMESTAMP '2024-01-02' ELSE TRUE END),
sc AS (SELECT query_id, id, round(sum(score), 6) AS score, len(list_distinct(flatten(list(asked)))) AS met, round(sum(score) FILTER (field = 'title'), 6) AS title, round(sum(score) FILTER (field = 'meta'), 6) AS meta, round(sum(score) FILTER (field = 'text'), 6) AS text FROM ok GROUP BY 1, 2),
nd AS (SELECT query_id, count(DISTINCT asked) AS needed FROM aw GROUP BY 1)"""


@query(f"WITH {_FIELDED} SELECT query_id, id, score, k - 1 AS rank, title, meta, text FROM (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM sc JOIN nd USING (query_id) WHERE met = needed) WHERE k <= 20")
def search_fielded(spark, sf_dir):
    """Search lines with operators, phrases and prefixes over fields that have weights, lengths and counts of their own: all terms met, with what each field adds."""
    return fielded(spark, sf_dir).select("query_id", "id", "score", "rank", *(F.col("by_field")[f].alias(f) for f in ("title", "meta", "text")))


def search_fielded_fuzzy(spark, sf_dir):
    """The same with edits. No SQL twin: DuckDB's edit distance counts bytes; a test compares with plain loops."""
    return fielded(spark, sf_dir, share=0.2).drop("by_field")


QUERIES["search_fielded_fuzzy"] = search_fielded_fuzzy


def related(contexts, lexical_text, vectors, units, unit_vectors, noted, out, low, k=8, legs=100, least=None):
    """Notes related to contexts: ``query_id, path, rank, fused, cosine, confidence``.

    ``contexts`` has ``query_id``; ``lexical_text`` its ``query_id, text`` whose longest words are met in any number; ``vectors`` its
    ``query_id, v``, several if it has several chunks, of which each unit keeps its best. ``units`` are
    ``id, path, text``, ``unit_vectors`` their ``id, v``, ``noted`` the notes that may show (``path`` and what ``low`` needs), ``out`` pairs ``query_id, path``
    that never do: the note itself, those it links to. With ``least``, a note's unit must be so near. ``low`` ones sink.
    """
    clean = T.squash(F.regexp_replace("text", r"\[\[|\]\]", " "))
    asked = lexical_text.select("query_id", F.explode(F.split(T.context_terms(clean), " ")).alias("term")).where("term <> ''")
    lexical = L.search_many(units.withColumnRenamed("id", "doc_id"), {"text": 1.0}, asked, legs).select(F.lit(0).alias("list_id"), "query_id", "id", "rank")
    # vectors of contexts get ids of their own, below those of units
    q = vectors.withColumn("id", -2 - F.pmod(F.xxhash64("query_id", "v"), F.lit(1 << 62)))
    near = S.top(S.cosines(q.select("id", "v").distinct(), unit_vectors, FLOOR, legs, most=units.count()), legs).drop("rank")
    near = near.withColumnRenamed("query_id", "_v").join(q.select(F.col("id").alias("_v"), "query_id"), "_v")
    near = cut(near.groupBy("query_id", "id").agg(F.max("cosine").alias("cosine")))
    vector = S.top(near, 1 << 30).select(F.lit(1).alias("list_id"), "query_id", "id", "rank")
    fused = R.rrf(lexical.unionByName(vector), by=("query_id",)).withColumn("fused", F.round("fused", 9)).join(contexts.select("query_id").distinct(), "query_id", "left_semi")
    best = R.collapse(fused.join(units.select("id", "path"), "id"), "path", by=("query_id",))
    best = best.join(noted, "path").join(out.select("query_id", "path").distinct(), ["query_id", "path"], "left_anti").join(near, ["query_id", "id"], "left")
    if least is not None:
        best = best.where(F.coalesce("cosine", F.lit(0.0)) >= least)
    ranked = R.sunk(best, low, "fused", "id", k, ("query_id",))
    return ranked.select("query_id", "path", "rank", "fused", "cosine", F.round(R.confidence(F.col("rank"), F.col("cosine")) + 1e-9, 4).alias("confidence"))


#: Sources whose notes stay quiet, and a language whose notes sink, in the queries below.
_QUIET, _LOW = "folder = 'src3'", "type = 'de'"


def _related(spark, sf_dir, text, least):
    n = notes(spark, sf_dir)
    v = S.hash_vectors(n.select("doc_id", F.col("content").alias("text")))
    units = n.select(F.col("doc_id").alias("id"), "path", F.col("content").alias("text"))
    focus = n.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "path", F.col(text).alias("text"))
    # the next note counts as one that the focus links to
    linked = focus.select("query_id", (F.col("query_id") + 1).alias("doc_id")).join(n.select("doc_id", "title"), "doc_id").join(n.select("title", "path"), "title")
    out = focus.select("query_id", "path").unionByName(linked.select("query_id", "path"))
    vectors = cut(S.hash_vectors(n.where("doc_id % 20 = 0").select("doc_id", F.col("content").alias("text"))).select(F.col("id").alias("query_id"), "v"))
    noted = n.where(f"not coalesce({_QUIET}, false)").select("path", "type")
    return related(focus, focus, vectors, units, v, noted, out, F.coalesce(F.expr(_LOW), F.lit(False)), least=least)


def _related_sql(text: str, least: float | None) -> str:
    body = _hybrid_sql().split("),\nfu AS")[0] + ")"
    focus = f"(SELECT doc_id AS item_id, {text} AS text FROM main.documents WHERE doc_id % 20 = 0)"
    body = body.replace("FROM benchmark", f"FROM {focus}", 1).replace("FROM benchmark", "FROM (SELECT doc_id AS item_id, text FROM main.documents WHERE doc_id % 20 = 0)")
    near = f"AND coalesce(cosine, 0) >= {least}" if least is not None else ""
    return rf"""{body}, fu AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + k)), 9) AS fused FROM (SELECT query_id, id, k FROM lx UNION ALL SELECT query_id, id, k FROM vx) GROUP BY 1, 2),
lk AS (SELECT a.doc_id - 1 AS query_id, b.doc_id AS id FROM documents a JOIN documents b ON a.text[1:60] = b.text[1:60] WHERE a.doc_id % 20 = 1),
rk AS (SELECT fu.*, cosine, d.source, row_number() OVER (PARTITION BY query_id ORDER BY (coalesce(d.lang = 'de', FALSE))::INT, fused DESC, id) AS k FROM fu JOIN documents d ON d.doc_id = fu.id LEFT JOIN vx USING (query_id, id)
  WHERE id <> query_id AND coalesce(d.source <> 'src3', TRUE) AND (query_id, id) NOT IN (SELECT query_id, id FROM lk) {near}),
z AS (SELECT *, 1.0::DOUBLE / k + (1 - 1.0::DOUBLE / k) * 0.35 * coalesce(least(1, greatest(0, (cosine - 0.55) / 0.3)), 0) AS s FROM rk WHERE k <= 8)
SELECT query_id, source || '/' || id || '.md' AS path, k - 1 AS rank, fused, cosine, round(s + 1e-9, 4) AS confidence FROM z"""


@query(_related_sql("text", 0.35))
def search_related(spark, sf_dir):
    """Notes related to the text of a note: not itself, none that it links to by title, none of a quiet folder, none farther than a floor; some sink."""
    return _related(spark, sf_dir, "content", 0.35)


@query(_related_sql("text[1:60]", None))
def search_related_note(spark, sf_dir):
    """Notes related to a stored note, by its own vectors and by the words of its title."""
    return _related(spark, sf_dir, "title", None)
