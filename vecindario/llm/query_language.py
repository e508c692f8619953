"""Query of the language identification."""

from __future__ import annotations

from . import language


def op8_language_id(spark, sf_dir):
    return language.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
