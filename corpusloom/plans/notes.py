"""The given tables as notes: the adapter that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import table


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as notes: the path is source/doc_id.md, the folder the source, the type the
    language, the title the first 60 characters, and the time 2024-01-01 plus doc_id hours."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("source").alias("folder"),
        F.col("lang").alias("type"),
        F.substring("text", 1, 60).alias("title"),
        (F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("mtime"),
        F.col("text").alias("content"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, n``: local links of each page and how often it has them."""
    hrefs = F.regexp_extract_all("html", F.lit(r'href="(/[^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), F.explode(hrefs).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


#: The same links in DuckDB SQL.
LINKS_SQL = """l AS (SELECT src, dst, count(*) AS n FROM (SELECT page_id AS src, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS dst FROM pages) GROUP BY 1, 2)"""
