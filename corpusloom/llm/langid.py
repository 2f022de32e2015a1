"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are code points in lower case, runs of others than letters count as one space.
Counts come from a bounded sample of labelled texts (``PER_LANG`` of each language in
expectation, by hash of the id); the matrix of log-probabilities, ``BUCKETS`` rows by
languages, is broadcast, and texts are scored by sums of its rows in numpy. The matrix of
more than ``SHARD`` languages is cut by language into several, each scored on its own.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import by_task, utf8
from corpusloom.sources.lineage import cut

BUCKETS = 1 << 15
ORDERS = 4
#: Training texts of a language, in expectation.
PER_LANG = 5000
#: Languages in a matrix: it then has 16 MB.
SHARD = 128
SMOOTH = 0.5
UNKNOWN = "und"
_PART = 1 << 20
_SPACE = np.uint32(32)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each code point, 2 for a letter, 1 for a mark that letters carry, else 0."""
    return np.array([2 if chr(c).isalpha() else unicodedata.category(chr(c))[0] == "M" for c in range(0x110000)], np.uint8)


def characters(raw: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes in lower case, with a space after each run of letters; nothing if there is no letter."""
    if (raw < 128).all():
        cp = raw.astype(np.uint32)
        cp[(raw >= 65) & (raw <= 90)] += _SPACE
    else:
        cp = np.frombuffer(raw.tobytes().decode("utf8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    kind = _kinds()[cp]
    if not (kind == 2).any():
        return cp[:0]
    word = kind > 0
    keep = word.copy()
    keep[1:] |= word[:-1]
    return np.where(word, cp, _SPACE)[keep]


def _grams(cp: np.ndarray):
    """Buckets of all n-grams of a text's characters, a part at a time."""
    for a in range(0, len(cp), _PART):
        part = cp[max(0, a - ORDERS + 1) : a + _PART]
        skip, h, out = a - max(0, a - ORDERS + 1), np.zeros(len(part), np.uint32), []
        for n in range(1, ORDERS + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) + part[n - 1 :]
            # those that end in this part
            own = h[max(0, skip - n + 1) :]
            out.append(((own + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15))
        yield np.concatenate(out)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offs = utf8(batch.column(0))
        for lang, a, b in zip(batch.column(1).to_pylist(), offs[:-1], offs[1:], strict=True):
            cp = characters(data[a:b])
            if len(cp):
                into = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for g in _grams(cp):
                    into += np.bincount(g, minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])


Shard = tuple[list[str], np.ndarray, np.ndarray]


def train(labelled: DataFrame) -> list[Shard]:
    """Languages in order, their log-probability matrix and the log of their shares, for each ``SHARD`` languages.

    ``labelled`` has ``text, lang, doc_id``; rows without a language teach nothing, nor
    do texts without a letter.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    known = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, PER_LANG / v)) for k, v in known.items()], "lang string, share double")
    drawn = labelled.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    grams = drawn.select("text", "lang").mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(known)
    grams = cut(grams) if len(names) > SHARD else grams
    out = []
    for k in range(0, len(names), SHARD):
        some = names[k : k + SHARD]
        got = (grams.where(F.col("lang").between(some[0], some[-1])) if len(names) > SHARD else grams).toPandas()  # at most SHARD times BUCKETS rows
        langs = sorted(set(got["lang"]))
        if langs:
            counts = np.zeros((BUCKETS, len(langs)))
            counts[got["bucket"].to_numpy(np.int64), np.searchsorted(langs, got["lang"].to_numpy(str))] = got["n"]
            prior = np.log([known[x] / sum(known.values()) for x in langs])
            out.append((langs, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)).astype(np.float32), prior))
    return out


def _told(shard: Shard, cp: np.ndarray) -> tuple[str, float, float]:
    """The likeliest language of a text, its log-likelihood, and by how much the sum over all languages is greater, as a log."""
    langs, matrix, prior = shard
    total = prior + sum(matrix[g].sum(0, dtype=np.float64) for g in _grams(cp))
    best = int(total.argmax())
    return langs[best], float(total[best]), float(np.log(np.exp(total - total[best]).sum()))


def predict(docs: DataFrame, model: list[Shard], *keep: Column) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``, its posterior probability.

    Texts that are null, empty or have no letter are ``und`` with score 0, and so is
    every text if nothing was learned. Ties go to the first language in order; repeated rows
    are told alike; an empty table gives an empty result; texts of any length count whole.
    """
    by_task(docs.sparkSession)
    # a task reads those that it scores with
    shards = [docs.sparkSession.sparkContext.broadcast(m) for m in model]
    told = ["lang_pred", "likely", "rest"]
    kinds = [pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        for batch in batches:
            data, offs = utf8(batch.column(0))
            rows = []
            for shard, a, b in zip(batch.column(1).to_pylist(), offs[:-1], offs[1:], strict=True):
                cp = characters(data[a:b])
                rows.append(_told(shards[shard].value, cp) if len(cp) and shards else (UNKNOWN, 0.0, -1.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], [*batch.schema.names[1:], *told])

    shard = F.lit(0) if len(shards) < 2 else F.explode(F.sequence(F.lit(0), F.lit(len(shards) - 1)))
    more = [] if len(shards) < 2 else [F.monotonically_increasing_id().alias("_row")]
    kept = docs.select(F.col("text").cast("string"), F.struct(*keep).alias("keep"), *more).select("text", shard.alias("shard"), "keep", *(["_row"] if more else []))
    if more:
        kept = kept.repartition("shard", F.pmod(F.col("_row"), F.lit(1024)))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[1:])
    rows = kept.mapInArrow(run, f"{schema}lang_pred string, likely double, rest double")
    if not more:
        return rows.select("keep.*", "lang_pred", F.when(F.col("rest") >= 0, F.exp(-F.col("rest"))).otherwise(0.0).alias("score"))
    # of each text a row from every shard: the likeliest language of all, and its share of all likelihoods
    every = F.array_sort(F.collect_list(F.struct((-F.col("likely")).alias("unlike"), "shard", "lang_pred", "rest")))
    rows = rows.groupBy("_row").agg(F.first("keep").alias("keep"), every.alias("every")).withColumn("best", F.col("every")[0])
    total = F.aggregate("every", F.lit(0.0), lambda s, x: s + F.exp(F.col("best.unlike") - x.unlike + x.rest))
    return rows.select("keep.*", "best.lang_pred", F.when(F.col("best.rest") >= 0, 1 / total).otherwise(0.0).alias("score"))
