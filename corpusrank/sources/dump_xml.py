"""Encyclopedia dumps: page XML and its multistream index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "id BIGINT, ns BIGINT, title STRING, redirect STRUCT<_title: STRING, _VALUE: STRING>, revision STRUCT<timestamp: STRING, text: STRUCT<_VALUE: STRING, _bytes: STRING>>"


def pages_from_xml(elements: DataFrame, column: str = "xml") -> DataFrame:
    """``<page>`` elements as articles (id, ns, title, redirect, timestamp, text).

    An empty text is ``""``; a page without id, ns, title, timestamp or text is left out.
    """
    page = F.from_xml(F.col(column), PAGE, {"rowTag": "page", "ignoreSurroundingSpaces": "false", "nullValue": "\u0000"}).alias("p")
    has_text = F.col(column).rlike(r"<text[\s/>]")
    rows = elements.select(page, has_text.alias("has_text")).select(
        "p.id", "p.ns", "p.title", F.col("p.redirect._title").alias("redirect"), F.col("p.revision.timestamp").alias("timestamp"),
        F.when(F.col("has_text"), F.coalesce(F.col("p.revision.text._VALUE"), F.lit(""))).alias("text"),
    )
    return rows.where("id is not null and ns is not null and title is not null and timestamp is not null and text is not null")


def page_elements(spark: SparkSession, path: str) -> DataFrame:
    """The ``<page>`` elements of a dump, plain or bz2; split at ``</page>``, so a large file is read by many tasks."""
    parts = spark.read.option("lineSep", "</page>").text(path)
    return parts.where(F.contains("value", F.lit("<page>"))).select(F.concat(F.regexp_extract("value", r"(?s)<page>.*", 0), F.lit("</page>")).alias("xml"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    return pages_from_xml(page_elements(spark, path))


def load_dump(spark: SparkSession, path: str, output: str) -> None:
    """Dump to Parquet; any error is raised."""
    read_dump(spark, path).write.mode("overwrite").option("compression", "zstd").parquet(output)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(offset, id, title) of a multistream index."""
    line = F.split("value", ":", 3)
    return spark.read.text(path).where(F.contains("value", F.lit(":"))).select(line[0].cast("long").alias("offset"), line[1].cast("long").alias("id"), line[2].alias("title"))


def stream_counts(index: DataFrame) -> DataFrame:
    """(offset, pages): how many pages each stream of a dump should hold."""
    return index.groupBy("offset").agg(F.count(F.lit(1)).alias("pages"))


def missing_pages(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Index entries that were not loaded."""
    return index.join(pages.select("id"), "id", "left_anti")
