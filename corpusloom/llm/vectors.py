"""Vector columns: which rows take part, and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """``vec_id long, v array<double>``: rows with an id and a vector of finite numbers
    (and, with ``nonzero``, other than zero). Repeated rows with one id count once."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad)
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.dropDuplicates(["vec_id"])


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def ranked(found: DataFrame, k: int, *extra: str) -> DataFrame:
    """The k best of ``query_id, vec_id, score`` per query with ``rank`` from 1, ties to the smaller id."""
    from pyspark.sql import Window

    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *extra)
