"""Move cluster centers with each micro-batch of word centroids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.projections.kmeans import seed_centers, step

ENTRIES = "word string, entries array<struct<term: string, weight: double>>"


def pack(centroids: DataFrame) -> DataFrame:
    """One row per word, so that a word never straddles two micro-batches."""
    return centroids.filter(F.col("term").isNotNull()).groupBy("word").agg(
        F.collect_list(F.struct("term", "weight")).alias("entries"))


def unpack(rows: DataFrame) -> DataFrame:
    return rows.select("word", F.explode("entries").alias("e")).select("word", "e.term", "e.weight")


def _state(out: str, batch: int) -> tuple[str, str]:
    return f"{out}/centers/batch={batch}", f"{out}/seen/batch={batch}"


def read_centers(spark: SparkSession, out: str, batch: int) -> tuple[DataFrame, np.ndarray]:
    """Centers and member counts after ``batch``."""
    centers, seen = _state(out, batch)
    counts = spark.read.parquet(seen).orderBy("label").collect()
    return spark.read.parquet(centers), np.array([r["n"] for r in counts], dtype=float)


def stream_centers(spark: SparkSession, source: str, out: str, checkpoint: str, k: int, *,
                   files_per_trigger: int = 100, seed: int = 0, schema: str | StructType = ENTRIES) -> StreamingQuery:
    """File stream of packed centroids; state is stored per batch.

    Batch b starts from the stored state of batch b-1 and overwrites its own, so a
    replay after a failure gives the same centers.
    """
    def update(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        words = unpack(rows)
        if batch == 0:
            centers, seen = seed_centers(words, k, seed=seed), np.zeros(k)
        else:
            centers, seen = read_centers(session, out, batch - 1)
        centers, seen = step(words, centers, seen)
        to_centers, to_seen = _state(out, batch)
        session.createDataFrame([(j, float(n)) for j, n in enumerate(seen)], "label int, n double").coalesce(
            1).write.mode("overwrite").parquet(to_seen)
        centers.write.mode("overwrite").parquet(to_centers)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return (
        stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
