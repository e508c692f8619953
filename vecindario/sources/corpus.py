"""Corpus scans: every source becomes ``lines(doc_id, line_no, line)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..session import spread


def lines_from_column(docs: DataFrame, *, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per line of a text column, with its 0-based position in the document."""
    docs = docs.select(*keys, text)
    if not docs.isStreaming:
        docs = spread(docs, *keys)
    split = F.split(F.col(text), "\n")
    return docs.select(*keys, F.posexplode(split).alias("line_no", "raw")).select(
        *keys, "line_no", T.strip(F.col("raw")).alias("line")
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of plain-text files, numbered from 0 within each file.

    Text files are split into blocks that many tasks read. A count per block gives
    each block the number of its first line, so no file passes through one task:
    the block table has one row per block and is the only thing joined.
    """
    raw = (
        spark.read.text(path, lineSep="\n")
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("block", F.col("_metadata.file_block_start"))
        .withColumn("position", F.monotonically_increasing_id())
    )
    blocks = raw.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("position").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return raw.join(blocks, ["file", "block"]).select(
        F.xxhash64("file").alias("doc_id"),
        (F.col("start") + F.col("position") - F.col("first")).alias("line_no"),
        T.strip(T.decode(F.col("value").cast("binary"))).alias("line"),
    )


def decode_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole files as text; invalid bytes become U+FFFD instead of failing the job."""
    return spark.read.format("binaryFile").load(path).select(
        F.xxhash64("path").alias("doc_id"), T.decode(F.col("content")).alias("text"))


def stack(*corpora: DataFrame) -> DataFrame:
    """All rows of several corpora with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), corpora)
