"""Query of the near duplicates."""

from __future__ import annotations

from . import near_duplicates


def op7_minhash_near_dedup(spark, sf_dir):
    return near_duplicates.classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_minhash_near_dedup": op7_minhash_near_dedup}
SQL: dict[str, str] = {}
