"""The postings table on storage: sorted for point lookups, built once and reused."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

ORDER = ("word", "doc_id", "line_no", "offset")


def write_postings(posts: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Parquet in word order, so that a lookup reads only matching row groups.

    The range covers the whole posting, so a very frequent word spans many files.
    """
    posts.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).write.mode(mode).parquet(path)


def write_bucketed(posts: DataFrame, table: str, *, buckets: int = 64, mode: str = "overwrite") -> None:
    """A table bucketed by word: later joins and groupings by word need no shuffle."""
    posts.write.mode(mode).bucketBy(buckets, "word").sortBy("word").saveAsTable(table)


def fingerprint(corpus: DataFrame) -> str:
    """Rows and a hash sum of a corpus, whatever its order and partitions; one scan."""
    hashed = F.xxhash64(*corpus.columns).cast("decimal(38,0)")
    rows, total = corpus.agg(F.count("*"), F.coalesce(F.sum(hashed), F.lit(0))).first()
    return f"{rows}:{total}"


def open_or_build(spark: SparkSession, path: str, build, *, corpus: DataFrame | None = None, **params) -> DataFrame:
    """Read the postings under ``path`` if they were built with ``params``, else build them.

    With ``corpus`` its fingerprint counts as a parameter, so an index of other lines is refused. ``build`` is called without arguments and returns the postings. The parameters are
    written last, so a half-written index is never taken for a finished one.
    """
    if corpus is not None:
        params["corpus"] = fingerprint(corpus)
    wanted = json.dumps(params, sort_keys=True)
    try:
        found = spark.read.text(f"{path}/params").first()
    except AnalysisException:
        found = None
    if found is None or found[0] != wanted:
        if found is not None:
            raise ValueError(f"index at {path} was built with {found[0]}")
        write_postings(build(), f"{path}/postings")
        spark.range(1).select(F.lit(wanted).alias("value")).write.mode("overwrite").text(f"{path}/params")
    return spark.read.parquet(f"{path}/postings")
