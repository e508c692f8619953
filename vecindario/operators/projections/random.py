"""Sparse random projection (Li, Hastie & Church 2006): one join, no fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ...session import cut
from .. import algebra as L


def project(sparse: DataFrame, terms: DataFrame, dim: int, *, by: str | list[str] = "word",
            density: float | None = None, seed: int = 42) -> DataFrame:
    """Wide table of ``dim`` columns; signs come from the hash of (seed, term, column).

    The default density 1/√terms leaves most terms without any sign, so the joined
    table is a small part of the vocabulary.
    """
    if density is None:
        size = terms.agg(F.count("*").cast("double").alias("n")).scalar()
        density = F.lit(1.0) / F.sqrt(size)
    signs = cut(L.seeded_signs(terms, "term", dim, density, seed=seed), "signs")
    return L.multiply(sparse, signs, by=by, on="term")


def reduce_terms(sparse: DataFrame, terms: DataFrame, dim: int, *, by: str | list[str] = "word",
                 seed: int = 42) -> DataFrame:
    """Distance-preserving reduction to ``dim`` columns, as a first step of other methods; entries of terms not in ``terms`` are zero.

    Signs are hashes of the term, so an entry meets no table and is summed where it lies; only terms that ``terms`` lacks are joined.
    """
    unknown = cut(sparse.select("term").distinct().join(terms.select("term"), "term", "left_anti").filter(
        F.col("term").isNotNull()), "unknown")
    if not unknown.isEmpty():
        marked = sparse.join(unknown.withColumn("unknown", F.lit(True)), "term", "left")
        sparse = marked.withColumn("weight", F.when(F.col("unknown").isNull(), F.col("weight"))).drop("unknown")
    return L.multiply_third_signs(sparse, dim, by=by, on="term", seed=seed)


def random_vectors(centroids: DataFrame, vocab: DataFrame, *, dim: int = 100,
                   density: float | None = None, seed: int = 42) -> DataFrame:
    return L.as_vectors(project(centroids, vocab.select("term"), dim, density=density, seed=seed))
