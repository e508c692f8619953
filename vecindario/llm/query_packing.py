"""Query of the packing."""

from __future__ import annotations

from . import packing, tokens


def op10_best_fit_packing(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(packing.token_pieces(documents, tokens.default_path()))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
SQL: dict[str, str] = {}
