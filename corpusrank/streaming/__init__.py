"""Structured Streaming over incoming submissions: the batch operators, incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs


def submission_stream(spark: SparkSession, path: str, schema: str = "url STRING, title STRING, created_utc BIGINT") -> DataFrame:
    """New JSON files of a folder as a stream (url, title, ts)."""
    return spark.readStream.schema(schema).json(path).select("url", "title", F.timestamp_seconds("created_utc").alias("ts"))


def dedup_within(stream: DataFrame, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """One submission per host and path within the watermark's delay; state older than it is dropped."""
    keyed = stream.withColumn("host", exprs.url_host(F.col("url"))).withColumn("path", exprs.url_path(F.col("url")))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["host", "path"])


def domain_counts(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Submissions per registrable domain and window."""
    domain = exprs.host_domain(exprs.url_host(F.col("url"))).alias("domain")
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, window), domain).agg(F.count(F.lit(1)).alias("n"))
