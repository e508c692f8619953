"""Query of the sharding."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import sharding


def op9_sharding(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = sharding.assign(sharding.measured(documents))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "tokens")


QUERIES = {"op9_sharding": op9_sharding}
SQL: dict[str, str] = {}
