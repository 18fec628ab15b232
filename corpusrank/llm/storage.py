"""Shared-folder helpers of the library, and keys for tables whose ids may repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, materialise, new_path, shared_dir

__all__ = ["broadcast_if_small", "fresh_name", "materialise", "new_path", "shared_dir", "small_batches", "text_volume", "with_unique_key"]


def text_volume(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts, counted: what numbers of buckets and tasks are derived from."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_unique_key(docs: DataFrame, id_col: str, key: str) -> DataFrame:
    """Add ``key``, a non-null long that is unique per row.

    It equals ``id_col`` where those are whole numbers, unique and complete (checked by one
    aggregation over that column alone).  Otherwise the rows are written once with a generated key,
    so that a lost task can't number them anew.
    """
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        n, known, distinct = docs.agg(F.count(F.lit(1)), F.count(id_col), F.countDistinct(id_col)).first()
        if n == known == distinct:
            return docs.withColumn(key, F.col(id_col).cast("long"))
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python in batches of at most ``rows`` rows, where the session has Spark's default of 10,000.

    A batch is held by the JVM and by the worker at once; with texts of some kilobytes the default is
    tens of megabytes a time, in every running task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(rows))
