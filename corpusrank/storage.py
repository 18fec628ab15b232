"""Intermediate tables in the folder that all executors share, so that a lost executor costs only a rerun of its tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only where that is unset and the session is local (tests)."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="corpusrank-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows dealt by ``key`` to some tasks for each core, for steps that compute much on few bytes: a file of one row group is one task to read, however many rows it has."""
    tasks = max(3 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *key)


BROADCAST_BYTES = 8 << 20


def counted_bytes(df: DataFrame) -> int:
    """Bytes of all rows: strings, binaries and arrays count with their own lengths, other columns and every row with 8 bytes."""
    row = F.lit(8)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        length = F.octet_length(field.name) if kind in ("string", "binary") else 8 * F.size(field.name) if kind in ("array", "map") else F.lit(8)
        row = row + F.coalesce(length, F.lit(0))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the counted bytes of all rows stay under ``max_bytes``; else Spark shuffles.

    ``df`` is read once for that, so it should be a written table.
    """
    return F.broadcast(df) if counted_bytes(df) <= max_bytes else df


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it is complete there, else computed, written and read back."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
