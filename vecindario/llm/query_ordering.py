"""Query of the training order."""

from __future__ import annotations

from ..session import scratch_path
from . import ordering, tokens


def op3_training_order(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "shards")
    return ordering.materialise(documents, tokens.default_path(), path if "://" in path or path.startswith("file:") else f"file://{path}")


QUERIES = {"op3_training_order": op3_training_order}
SQL: dict[str, str] = {}
