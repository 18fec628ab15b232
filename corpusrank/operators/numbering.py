"""Dense numbering without a single-task sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialise


def dense_ids(df: DataFrame, order: list[str], name: str = "node_id") -> DataFrame:
    """``df`` with 0..n-1 in the order of ``order`` (which should tell rows apart).

    A range sort numbers rows within their task; one row per task then gives every task its offset.
    The numbered rows are written once, so a task that runs again can't deal numbers anew.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__task", T.LongType()), T.StructField(name, T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task)), pa.array(seen + np.arange(n))], names=[*batch.schema.names, "__task", name])
            seen += n

    local = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "numbered")
    offsets, base = [], 0
    for task, n in sorted(local.groupBy("__task").count().collect()):
        offsets.append((task, base))
        base += n
    table = df.sparkSession.createDataFrame(offsets, "__task long, __base long")
    return local.join(F.broadcast(table), "__task").withColumn(name, F.col(name) + F.col("__base")).drop("__task", "__base")
