"""Word vectors as text lines (``word v1 … vd`` after a ``rows dim`` header), weights and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, AtomicType, StringType

from ..functions.text import format_vector

HEADER = r"^\d+ \d+$"


def vector_lines(vectors: DataFrame) -> DataFrame:
    """``(ord, word, line)``; the header has ``ord`` 0 and the vectors 1."""
    rows = vectors.select(
        F.lit(1).alias("ord"), "word", F.concat_ws(" ", "word", format_vector(F.col("vec"))).alias("line"))
    header = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("d")).select(
        F.lit(0).alias("ord"), F.lit("").alias("word"), F.concat_ws(" ", "n", "d").alias("line"))
    return header.unionByName(rows)


def write_vectors(vectors: DataFrame, path: str, *, single_file: bool = False, mode: str = "errorifexists") -> None:
    """Text parts that give one vector file when put together in name order.

    Executors write side by side; ``single_file`` is for small results only.
    """
    lines = vector_lines(vectors).orderBy("ord", "word").select("line")
    (lines.coalesce(1) if single_file else lines).write.mode(mode).text(path)


def parse_vectors(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(word, vec)`` from text lines, leaving out headers and empty lines."""
    parts = F.split(F.col(column), " ")
    kept = lines.filter(~F.col(column).rlike(HEADER) & (F.length(column) > 0)).select(parts.alias("p"))
    numbers: Column = F.slice("p", F.lit(2), F.size("p") - 1).cast("array<double>")
    return kept.select(F.col("p")[0].alias("word"), numbers.alias("vec"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_vectors(spark.read.text(path))


def write_weights(vocab: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Save ``(term, df, idf)`` for use on other corpora."""
    vocab.write.mode(mode).parquet(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_predictions(rows: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """CSV with arrays of text joined by blanks; vectors and other nested columns are left out."""
    cols = []
    for field in rows.schema.fields:
        if isinstance(field.dataType, AtomicType):
            cols.append(F.col(field.name))
        elif isinstance(field.dataType, ArrayType) and isinstance(field.dataType.elementType, StringType):
            cols.append(F.array_join(field.name, " ").alias(field.name))
    rows.select(*cols).write.mode(mode).csv(path, header=True)
