"""Gapless numbers within few groups, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import cut


def numbered(rows: DataFrame, group: str, name: str, few: bool = False) -> DataFrame:
    """Add ``name``: 0, 1, ... within each value of the integer column ``group``, in the order of the partitions.

    Each task counts as it passes its rows; the counts per task and group (few groups, so tasks x groups
    short rows) are summed up in task order and added. The rows are written once, so a retried task
    can't number them anew. ``group`` needs a bounded number of values; with ``few`` it is a handful, and the
    counts (a few short rows per task) are broadcast, so wide rows aren't shuffled for them.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            values, first, sizes = np.unique(keys[order], return_index=True, return_counts=True)
            local = np.empty(len(keys), dtype=np.int64)
            local[order] = np.arange(len(keys)) - np.repeat(first, sizes) + np.repeat(np.array([seen.get(v, 0) for v in values.tolist()], dtype=np.int64), sizes)
            for v, n in zip(values.tolist(), sizes.tolist(), strict=True):
                seen[v] = seen.get(v, 0) + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), part, dtype=np.int32)), pa.array(local)],
                                             names=[*batch.schema.names, "_part", "_local"])

    return placed(cut(rows.mapInArrow(count, schema), "numbered"), group, name, few)


def placed(counted: DataFrame, group: str, name: str, few: bool = False) -> DataFrame:
    """``numbered`` for written rows that already hold their task's ``_part`` and their ``_local`` number in its group."""
    sizes = counted.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (counted.join(F.broadcast(offsets) if few else offsets, [group, "_part"]).withColumn(name, F.col("_before") + F.col("_local"))
            .select(*[c for c in counted.columns if c not in ("_part", "_local")], name))
