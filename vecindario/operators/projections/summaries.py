"""Cluster-feature summaries after BIRCH (Zhang, Ramakrishnan & Livny 1996).

A summary (count, sum, sum of squares) is additive. Buckets of bounded size are
summarized side by side, the summaries are clustered by their weights, and every word
gets its distances to the resulting centers. When a bucket needs more summaries than
allowed, its threshold grows and summaries merge, so no row is ever left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ...session import cut
from .. import algebra as L
from .random import reduce_terms

SUMMARY = "n double, ls array<double>, ss double"


def summarize(points: np.ndarray, threshold: float, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Absorb each point into the nearest summary whose mean is within ``threshold``.

    Returns counts, linear sums and square sums. Going beyond ``limit`` summaries
    raises the threshold by half and absorbs the summaries into each other.
    """
    n, ls, ss = np.ones(len(points)), points, (points * points).sum(axis=1)
    done, width = 0, points.shape[1]
    kept_n, kept_ls, kept_ss = np.zeros(0), np.zeros((0, width)), np.zeros(0)
    while done < len(points):
        room = limit + 1
        kept_n, kept_ls, kept_ss, took = _absorb(
            (kept_n, kept_ls, kept_ss), (n[done:], ls[done:], ss[done:]), threshold, room)
        done += took
        while len(kept_n) > limit or (done < len(points) and len(kept_n) == room):
            threshold *= 1.5
            empty = (np.zeros(0), np.zeros((0, width)), np.zeros(0))
            kept_n, kept_ls, kept_ss, _ = _absorb(empty, (kept_n, kept_ls, kept_ss), threshold, len(kept_n))
    return kept_n, kept_ls, kept_ss


def _absorb(kept, new, threshold: float, room: int):
    """Add entries to the kept summaries until ``room`` is used up; also tells how many were taken."""
    used = len(kept[0])
    n, ls, ss = np.zeros(room), np.zeros((room, new[1].shape[1])), np.zeros(room)
    n[:used], ls[:used], ss[:used] = kept
    means = np.zeros_like(ls)
    means[:used] = ls[:used] / n[:used, None]
    for taken, (cn, cl, cs) in enumerate(zip(*new)):
        best = None
        if used:
            gaps = ((means[:used] - cl / cn) ** 2).sum(axis=1)
            best = int(gaps.argmin())
        if best is None or gaps[best] > threshold**2:
            if used == room:
                return n, ls, ss, taken
            best, used = used, used + 1
        n[best], ls[best], ss[best] = n[best] + cn, ls[best] + cl, ss[best] + cs
        means[best] = ls[best] / n[best]
    return n[:used].copy(), ls[:used].copy(), ss[:used].copy(), len(new[0])


def bucket_summaries(dense: DataFrame, *, threshold: float = 0.5, limit: int = 256, bucket_rows: int = 4096) -> DataFrame:
    """``(n, ls, ss)`` of hash buckets with about ``bucket_rows`` words each."""
    cols = L.dense_columns(dense)
    buckets = max(1, -(-dense.count() // bucket_rows))

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        points = batch.sort_values("word")[cols].to_numpy(dtype=float)
        n, ls, ss = summarize(points, threshold, limit)
        return pd.DataFrame({"n": n, "ls": list(ls), "ss": ss})

    return (
        dense.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)))
        .groupBy("bucket").applyInPandas(work, SUMMARY)
    )


def distances(dense: DataFrame, centers: np.ndarray, key: str = "word") -> DataFrame:
    """``(key, vec)``: Euclidean distances to a small matrix of centers."""
    cols = L.dense_columns(dense)
    schema = StructType([dense.schema[key], StructField("vec", ArrayType(DoubleType()))])
    norms = (centers * centers).sum(axis=1)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[cols].to_numpy(dtype=float)
            squared = (x * x).sum(axis=1)[:, None] - 2.0 * x @ centers.T + norms
            yield pd.DataFrame({key: batch[key].to_numpy(), "vec": list(np.sqrt(np.maximum(squared, 0.0)))})

    return dense.select(key, *cols).mapInPandas(work, schema)


def summary_vectors(centroids: DataFrame, vocab: DataFrame, *, dim: int = 100, threshold: float = 0.5,
                    reduced: int = 64, limit: int = 256, bucket_rows: int = 4096, seed: int = 42) -> DataFrame:
    """Distances of every word to the centers of weighted summaries.

    There are ``dim`` centers, or one per summary if fewer summaries were needed.
    """
    dense = cut(reduce_terms(centroids, vocab, reduced, seed=seed), "reduced")
    found = cut(bucket_summaries(dense, threshold=threshold, limit=limit, bucket_rows=bucket_rows), "summaries")
    rows = found.select("n", array_to_vector(F.transform("ls", lambda x: x / F.col("n"))).alias("features"))
    model = KMeans(k=min(dim, rows.count()), seed=seed, weightCol="n").fit(rows)
    return distances(dense, np.array(model.clusterCenters()))
