"""Intermediate results that survive a lost executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """The folder of intermediate results that the cluster names in ``spark.checkpoint.dir``.

    Only where none is set and the master is local (tests, a laptop) is a temporary one
    made: other machines couldn't read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from the reliable checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "corpusloom-"))
    return df.checkpoint()


def tallied(df: DataFrame, *totals: Column) -> tuple[DataFrame, tuple]:
    """The rows as ``cut`` gives them, and totals over them (without any: their number), taken while they are written."""
    seen = Observation()
    named = [t.alias(f"t{k}") for k, t in enumerate(totals or [F.count(F.lit(1))])]
    out = cut(df.observe(seen, *named))
    return out, tuple(seen.get[f"t{k}"] for k in range(len(named)))
