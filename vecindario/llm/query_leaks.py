"""Query of the benchmark decontamination."""

from __future__ import annotations

from . import decontamination


def op4_benchmark_decontamination(spark, sf_dir):
    documents, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontamination.leaks(documents, items)


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
SQL: dict[str, str] = {}
