"""Linear discriminant vectors: every word is a class, its windows are the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ...session import cut
from .. import algebra as L
from ..weights import WINDOW_KEYS
from .random import reduce_terms


def directions(between: np.ndarray, within: np.ndarray, dim: int, ridge: float = 1e-6) -> np.ndarray:
    """Leading solutions of between·v = λ·within·v."""
    floor = ridge * max(np.trace(within) / len(within), 1e-300)
    half = L.whitener(within + floor * np.eye(len(within)))
    values, vectors = np.linalg.eigh(half.T @ between @ half)
    lead = np.argsort(values)[::-1][:dim]
    out = half @ vectors[:, lead]
    return out * np.where(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])] < 0, -1.0, 1.0)


def _sums(rows: DataFrame) -> DataFrame:
    """``(kind, word, i, n, c0 …)`` of the windows' rows: for each word (kind 0) their number and sum, and the rows ``i`` of their Gram matrix (kind 1).

    A task keeps a sum for each of its words, so windows that are dealt by word are not written or shuffled.
    """
    cols = L.dense_columns(rows)
    k = len(cols)
    schema = StructType([StructField("kind", IntegerType()), rows.schema["word"], StructField("i", IntegerType()), StructField("n", LongType()),
                         *[StructField(c, DoubleType()) for c in cols]])
    fields = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, numbers, sums, counts = np.zeros((k, k)), {}, np.zeros((1024, k)), np.zeros(1024, dtype=np.int64)
        for batch in batches:
            x = np.stack([batch.column(j + 1).to_numpy() for j in range(k)], axis=1)
            gram += x.T @ x
            words = batch.column(0).dictionary_encode(null_encoding="encode")
            at = np.array([numbers.setdefault(w, len(numbers)) for w in words.dictionary.to_pylist()], dtype=np.int64)[words.indices.to_numpy()]
            while len(counts) < len(numbers):
                sums, counts = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([counts, np.zeros_like(counts)])
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(first):
                sums[at[order][first]] += np.add.reduceat(x[order], first, axis=0)
                counts[:len(numbers)] += np.bincount(at, minlength=len(numbers))
        n = len(numbers)
        for kind, words, i, n_rows, values in ((0, list(numbers), [None] * n, counts[:n], sums[:n]), (1, [None] * k, range(k), np.zeros(k), gram)):
            given = [pa.array(np.full(len(values), kind)), pa.array(words, fields.field("word").type), pa.array(i, pa.int32()), pa.array(n_rows), *map(pa.array, values.T)]
            yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(given, fields)], schema=fields)

    parts = rows.select("word", *cols).mapInArrow(work, schema)
    return parts.groupBy("kind", "word", "i").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols])


def discriminant_vectors(window_weights: DataFrame, vocab: DataFrame, *, dim: int = 100, reduced: int | None = None,
                         seed: int = 42, keys: tuple[str, ...] = WINDOW_KEYS, known: bool = False) -> DataFrame:
    """Project class means on the directions that separate words from each other.

    ``window_weights`` holds one weight vector per window, ``(keys…, term, weight)``; ``known`` tells that all its terms
    are in ``vocab``, so it is read once and not written. Terms are first reduced to ``reduced`` columns, and one pass
    sums the windows by word and their scatter matrix: total and between scatter give the within scatter by difference.
    """
    reduced = max(dim, min(256, 4 * dim)) if reduced is None else reduced
    if dim > reduced:
        raise ValueError("dim must not exceed the reduced number of columns")
    window_weights = window_weights.select(*keys, "term", "weight")
    if known:
        rows = L.multiply_third_signs(window_weights, reduced, by=list(keys), on="term", seed=seed)
    else:
        rows = reduce_terms(cut(window_weights, "weights"), vocab, reduced, by=list(keys), seed=seed)
    found = cut(_sums(rows), "sums")
    cols = L.dense_columns(rows)
    totals = found.filter(F.col("kind") == 0)
    gram = found.filter(F.col("kind") == 1).orderBy("i").select(*cols).toPandas().to_numpy().reshape(-1, reduced)
    n_rows, n_classes = totals.agg(F.sum("n"), F.count("*")).first()
    mean = L.column_sums(totals) / n_rows
    center = n_rows * np.outer(mean, mean)
    scaled = totals.select("word", *[(F.col(c) / F.sqrt("n")).alias(c) for c in cols])
    total, between = gram - center, L.gram(scaled) - center
    axes = directions(between, total - between, min(dim, max(n_classes - 1, 1)))
    shifted = totals.select("word", *[(F.col(c) / F.col("n") - float(m)).alias(c) for c, m in zip(cols, mean)])
    return L.as_vectors(L.rotate(shifted, axes, "word"))
