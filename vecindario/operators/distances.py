"""Distances to centers in dense vector columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .projections.summaries import distances as small_distances


def center_means(rows: DataFrame, *, label: str = "label", vec: str = "embedding") -> DataFrame:
    """``(label, dim, value)``: mean vector per label in long form."""
    return (
        rows.select(label, F.posexplode(vec).alias("dim", "x"))
        .groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))
    )


def center_distances(rows: DataFrame, centers: DataFrame, *, key: str = "vec_id", vec: str = "embedding",
                     label: str = "label", max_values: int = 1 << 20) -> DataFrame:
    """``(key, center, distance)`` as sqrt(|x|² - 2x·c + |c|²).

    ``centers`` is ``(label, dim, value)``. Up to ``max_values`` numbers travel to the
    tasks as one matrix; beyond that the centers are joined coordinate by coordinate.
    """
    if centers.limit(max_values + 1).count() <= max_values:
        table = centers.toPandas().pivot(index=label, columns="dim", values="value").sort_index()
        names, matrix = [x.item() for x in table.index.to_numpy()], table.to_numpy(dtype=float)
        dense = rows.select(key, *[F.col(vec)[j].cast("double").alias(f"c{j}") for j in range(matrix.shape[1])])
        center = F.element_at(F.lit(names), F.col("pos") + 1)
        return small_distances(dense, np.ascontiguousarray(matrix), key).select(
            key, F.posexplode("vec").alias("pos", "distance")).select(key, center.alias("center"), "distance")
    long = rows.select(key, F.posexplode(vec).alias("dim", "x"))
    both = long.join(centers.withColumnRenamed(label, "center"), "dim")
    x, c = F.col("x").cast("double"), F.col("value")
    squared = F.sum(x * x) - F.sum(x * c) * 2.0 + F.sum(c * c)
    return both.groupBy(key, "center").agg(F.sqrt(F.greatest(squared, F.lit(0.0))).alias("distance"))
