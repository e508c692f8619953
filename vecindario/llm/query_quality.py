"""Query of the quality classifier."""

from __future__ import annotations

from . import quality_model


def op6_quality_classifier(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_model.classify(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
SQL: dict[str, str] = {}
