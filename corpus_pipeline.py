"""The corpus pipeline: toxic documents go, one of each group of near-duplicates stays,
personal data are masked, sources are mixed to their weights, and the rest is encoded.

Each stage keeps the columns of the documents it gets, whatever they are called, but for the last;
null and very long texts, null and repeated ids, repeated rows and empty tables are
taken by every stage as its docstring says.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, mixing, neardup, pii, toxicity
from corpusloom.sources.lineage import shared_folder
from corpusloom.sources.tables import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples call toxic go.

    Null and empty texts are judged like texts without a known word, so they stay unless most examples
    without known words are toxic; copies of a text share their fate; rows of labels without a
    usable label teach nothing. A table without rows stays so.
    """
    labels = table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.reject(docs, toxicity.train(docs, labels.where(~held_out)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles 0.8 alike stays.

    That of the smallest id. Texts without words, null ones and rows without an id all stay; a repeated row
    stays as often as it comes in. Texts are compared whole.
    """
    return neardup.near_dedup(docs, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in texts become their kind.

    Null texts stay null, empty ones empty; no row goes; repeated rows are masked alike.
    """
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until sources have their target words.

    Texts without words, and null ones, have no size and are left out; a null source counts as one, after all others.
    Copies are drawn by a hash of the id (of the text where it is null), so reruns agree and repeated rows are taken alike.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; one row for each copy of a document.

    Null texts have no ids; rows keep a null or repeated id.
    """
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Votes, sketches and token ids have no SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    What a stage has written goes once the next one is written; the last table stays, as the result reads it."""
    docs, home, before = table(spark, sf_dir, "documents"), _home(spark), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = _written(spark, out, name, home)
        if before:
            _remove(spark, f"{home}-{before}")
        before = name
    return docs


def _home(spark: SparkSession) -> str:
    """What the names of a run's tables begin with, in the folder that all executors share."""
    return f"{shared_folder(spark, 'corpus-pipeline-')}/pipeline-{uuid.uuid4().hex}"


def _written(spark: SparkSession, df: DataFrame, name: str, home: str | None = None) -> DataFrame:
    """The rows, in a table of the shared folder."""
    path = f"{home or _home(spark)}-{name}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Removes a table, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
