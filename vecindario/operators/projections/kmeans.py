"""K-means in long form: centers are a table by term, so no vocabulary has to fit anywhere.

A round sends the centers to the slices of the matrix, picks the nearest center per word and sums the members
there, and averages the sums. Two numbers per center and slice reach the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ...functions.hashing import hash01
from ...session import cut, scratch_path
from .. import algebra as L
from ..slices import MESSAGE, Part, block_sums, combined, sliced_head


def _merged(points: np.ndarray, size: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Group of each weighted point: weighted k-means++ picks, then Lloyd rounds while no group is empty."""
    if len(points) <= k:
        return np.arange(len(points))
    rng = np.random.default_rng(seed)
    picks = [int(rng.choice(len(points), p=size / size.sum()))]
    gap = np.full(len(points), np.inf)
    while len(picks) < k:
        gap = np.minimum(gap, ((points - points[picks[-1]]) ** 2).sum(axis=1))
        gap[picks] = 0.0
        mass = gap * size
        if mass.sum() > 0:
            picks.append(int(rng.choice(len(points), p=mass / mass.sum())))
        else:
            picks.append(next(i for i in range(len(points)) if i not in picks))

    def closest(centers: np.ndarray) -> np.ndarray:
        return ((centers * centers).sum(axis=1) - 2.0 * points @ centers.T).argmin(axis=1)

    labels = closest(points[picks])
    labels[picks] = np.arange(k)
    for _ in range(50):
        total = np.bincount(labels, size, k)
        means = np.stack([np.bincount(labels, size * x, k) for x in points.T], axis=1) / total[:, None]
        new = closest(means)
        if len(np.unique(new)) < k or (new == labels).all():
            break
        labels = new
    return labels


def seed_centers(filled: DataFrame, k: int, *, seed: int = 0, rounds: int = 5, oversampling: float = 2.0,
                 sketch: int = 32, head: L.Head | None = None) -> DataFrame:
    """Starting centers ``(term, c0 …)`` by k-means|| (Bahmani et al. 2012) over all words.

    A round draws each word with probability ``oversampling·k·gap/cost`` by its hash, where ``gap`` is its squared
    distance to the nearest candidate. Rounds go on past ``rounds`` while there are fewer than ``k`` candidates.
    Then each candidate weighs as many words as it is nearest to, and weighted k-means merges them into ``k``
    centers. The driver gets ``sketch`` random sums per candidate, about ``rounds·oversampling·k`` rows whatever
    the vocabulary; the centers themselves are a join. With fewer than ``k`` distinct vectors the rest are copies.
    """
    spark = filled.sparkSession
    points = cut(L.squared_norms(filled, by="word"), "points")
    words, mass = points.agg(F.count("*"), F.coalesce(F.sum("norm2"), F.lit(0.0))).first()
    if words < k:
        raise ValueError(f"{words} words cannot give {k} centers")
    state = points.select("word", "norm2", F.lit(float("inf")).alias("gap"), F.lit(-1).alias("owner"))
    drawn = points.orderBy(hash01("word", seed=seed), "word").select("word").limit(1)
    lists, taken, turn = [], 0, 0
    while True:
        number = F.row_number().over(Window.orderBy("word")).cast("int") - 1
        fresh = cut(drawn.select("word", number.alias("label")), "fresh")
        n = fresh.count()
        if n:
            near = nearest(filled, cut(member_sums(filled, fresh, n), "block"), head)
            gap = F.greatest(F.col("norm2") + F.col("score"), F.lit(0.0))
            gap = F.when(gap <= F.col("norm2") * 1e-12, 0.0).otherwise(gap)
            state = cut(state.join(near, "word").select(
                "word", "norm2", F.least("gap", gap).alias("gap"),
                F.when(gap < F.col("gap"), F.col("label") + taken).otherwise(F.col("owner")).alias("owner")), "gaps")
            lists.append(fresh.withColumn("label", F.col("label") + taken))
            taken += n
        cost = state.agg(F.sum("gap")).first()[0]
        if cost <= 1e-12 * mass or (turn >= rounds and taken >= k):
            break
        turn += 1
        chance = F.col("gap") * (oversampling * k / cost)
        drawn = state.filter((F.col("gap") > 0) & (hash01("word", seed=seed + 7919 * turn) < chance)).select("word")

    candidates = reduce(DataFrame.unionByName, lists).withColumnRenamed("label", "owner")
    sizes = state.groupBy("owner").agg(F.count("*").cast("double").alias("size"))
    candidates = cut(candidates.join(sizes, "owner"), "candidates")
    entries = cut(filled.join(candidates, "word"), "entries")
    signs = L.seeded_block(entries.select("term").distinct(), "term", sketch, seed=seed)
    rows = L.multiply(entries, signs, by=["owner", "word", "size"], on="term").orderBy("owner").collect()
    names, size = [r["word"] for r in rows], np.array([r["size"] for r in rows])
    labels = _merged(np.array([list(r)[3:] for r in rows]), size, k, seed)
    share = size / np.bincount(labels, size)[labels]
    merged = list(zip(names, map(int, labels), map(float, share)))
    if len(names) < k:
        spare = points.join(candidates, "word", "left_anti").orderBy(hash01("word", seed=seed), "word").limit(k - len(names))
        merged += [(r["word"], len(names) + j, 1.0) for j, r in enumerate(spare.collect())]
    parts = spark.createDataFrame(merged, StructType([filled.schema["word"]]).add("label", "integer").add("share", "double"))
    scaled = filled.join(parts, "word").select("word", "term", (F.col("weight") * F.col("share")).alias("weight"))
    return cut(member_sums(scaled, parts.drop("share"), k), "centers")


def head_terms(filled: DataFrame, k: int) -> L.Head:
    """The slices of the matrix, for products with centers as with the candidates of a seeding round."""
    return sliced_head(filled, by="word", on="term")


def nearest(filled: DataFrame, centers: DataFrame, head: L.Head | None = None) -> DataFrame:
    """``(word, label, score)``: the nearest center and |c|² - 2x·c, the squared distance without |x|²."""
    cols = L.dense_columns(centers)
    norms = L.column_sums(centers.select("term", *[(F.col(c) * F.col(c)).alias(c) for c in cols]))
    dots = L.multiply(filled, centers, by="word", on="term", head=head)
    scores = F.array(*[F.lit(float(n)) - F.col(c) * 2.0 for n, c in zip(norms, cols)])
    return dots.select("word", scores.alias("scores")).select(
        "word", (F.array_position("scores", F.array_min("scores")) - 1).cast("int").alias("label"),
        F.array_min("scores").alias("score"))


def assign(filled: DataFrame, centers: DataFrame, head: L.Head | None = None) -> DataFrame:
    """``(word, label)``: the nearest center."""
    return nearest(filled, centers, head).select("word", "label")


def member_counts(labels: DataFrame, k: int) -> np.ndarray:
    counts = np.zeros(k)
    for row in labels.groupBy("label").count().collect():
        counts[row["label"]] = row["count"]
    return counts


def member_sums(filled: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``(term, c0 …)``: sum of the members' weights per center, added up in long form first."""
    sums = filled.join(labels, "word").groupBy("term", "label").agg(F.sum("weight").alias("s"))
    cells = sums.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("label", "s"))).alias("m"))
    row = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.coalesce(F.col("m")[j], F.lit(0.0)))
    return cells.select("term", row.alias("m")).select("term", *[F.col("m")[j].alias(f"c{j}") for j in range(k)])


def blend(centers: DataFrame, sums: DataFrame, seen: np.ndarray, batch: np.ndarray) -> DataFrame:
    """Running mean: ``c + (mean - c)·n/(N + n)`` with N rows seen and n rows in the batch."""
    total = seen + batch
    cols = L.dense_columns(centers)
    new = sums.select("term", *[F.col(c).alias(f"s{c}") for c in cols])
    keep = [float(s / t) if b > 0 else 1.0 for s, t, b in zip(seen, total, batch)]
    gain = [float(1.0 / t) if b > 0 else 0.0 for t, b in zip(total, batch)]
    return centers.join(new, "term", "full").select("term", *[
        (F.coalesce(F.col(c), F.lit(0.0)) * a + F.coalesce(F.col(f"s{c}"), F.lit(0.0)) * g).alias(c)
        for c, a, g in zip(cols, keep, gain)])


def lloyd(filled: DataFrame, k: int, *, rounds: int = 100, tolerance: float = 1e-4, seed: int = 0,
          head: L.Head | None = None) -> DataFrame:
    """Full-batch k-means; ends once a round lowers the cost by no more than ``tolerance`` of itself."""
    head = head_terms(filled, k) if head is None or head.slices is None else head
    slices = head.slices
    centers = slices.blocks(seed_centers(filled, k, seed=seed, head=head), "term")
    mass = filled.agg(F.coalesce(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0))).first()[0]
    before = None
    for _ in range(rounds):
        norms = block_sums(centers, lambda x: (x * x).sum(axis=0), k)

        def step(part: Part, norms: np.ndarray = norms) -> list[dict]:
            scores = norms - 2.0 * part.cells.forward(part.dense, part.n_rows)
            label = scores.argmin(axis=1)
            own, size = part.cells, len(part.dense)
            sums = np.bincount(own.col * k + label[own.row], own.value, size * k).reshape(size, k)
            stats = np.zeros((2, k))
            stats[0], stats[1, 0] = np.bincount(label, minlength=k), scores.min(axis=1).sum()
            return [{"q": -1, "n": 2, "at": np.arange(2, dtype=np.int32).tobytes(), "data": stats.tobytes()}, *part.partial(sums)]

        moved = cut(slices.total(slices.work(slices.send(centers, k), k, step, MESSAGE), k), "moved")
        counts, score = np.frombuffer(moved.filter("q = -1").first()["data"]).reshape(2, k)
        cost = max(mass + score[0], 0.0)
        if before is not None and before - cost <= tolerance * before:
            break
        before = cost
        gain = 1.0 / np.maximum(counts, 1.0)
        centers = cut(combined(centers, moved, k, lambda c, s, n=counts, g=gain: np.where(n > 0, s * g, c)), "centers")
    return cut(slices.wide(centers, k, "term"), "centers")


def kmeans_vectors(centroids: DataFrame, *, dim: int = 100, rounds: int = 100, tolerance: float = 1e-4,
                   seed: int = 0) -> DataFrame:
    """Dot products of each word with ``dim`` k-means centers."""
    filled = centroids.filter(F.col("term").isNotNull())
    head = head_terms(filled, dim)
    centers = lloyd(filled, dim, rounds=rounds, tolerance=tolerance, seed=seed, head=head)
    return L.as_vectors(_dots(centroids, filled, centers, head))


def _dots(centroids: DataFrame, filled: DataFrame, centers: DataFrame, head: L.Head) -> DataFrame:
    """Dot products of all words, zeros for those without a term."""
    empty = centroids.filter(F.col("term").isNull()).select("word").distinct().join(filled.select("word"), "word", "left_anti")
    dots = L.multiply(filled, centers, by="word", on="term", head=head)
    return dots.unionByName(empty.select("word", *[F.lit(0.0).alias(c) for c in L.dense_columns(centers)]))


def minibatch_centers(filled: DataFrame, k: int, *, batch_size: int | None = None, n_batches: int | None = None,
                      seed: int = 0, head: L.Head | None = None) -> DataFrame:
    """One pass over all words in hash-ordered batches, each moving the centers.

    Give either the words per batch or the number of batches; large corpora want few,
    large batches because batches run one after the other.
    """
    spark = filled.sparkSession
    n = filled.select("word").distinct().count()
    if n_batches is None:
        batch_size = 100 if batch_size is None else batch_size
        if k > batch_size:
            raise ValueError("the batch size must not be smaller than the number of centers")
        if batch_size > n:
            raise ValueError(f"the batch size exceeds the vocabulary of {n} words")
        n_batches = -(-n // batch_size)
    path = scratch_path(spark, "batches")
    batch = F.floor(hash01("word", seed=seed) * n_batches).cast("int")
    filled.select("word", "term", "weight", batch.alias("batch")).write.partitionBy("batch").parquet(path)
    parts = spark.read.parquet(path)
    centers, seen = seed_centers(filled, k, seed=seed, head=head), np.zeros(k)
    head = L.head(filled, "term", 2 * k)  # a batch is multiplied once, which would not repay slices of its own
    for b in range(n_batches):
        rows = parts.filter(F.col("batch") == b).drop("batch")
        centers, seen = step(rows, centers, seen, head)
    return centers


def step(rows: DataFrame, centers: DataFrame, seen: np.ndarray, head: L.Head | None = None) -> tuple[DataFrame, np.ndarray]:
    """Move the centers by one batch of words."""
    k = len(seen)
    labels = cut(assign(rows, centers, head), "labels")
    batch = member_counts(labels, k)
    centers = cut(blend(centers, member_sums(rows, labels, k), seen, batch), "centers")
    return centers, seen + batch


def minibatch_vectors(centroids: DataFrame, *, dim: int = 100, batch_size: int | None = None,
                      n_batches: int | None = None, seed: int = 0) -> DataFrame:
    filled = centroids.filter(F.col("term").isNotNull())
    head = head_terms(filled, dim)
    centers = minibatch_centers(filled, dim, batch_size=batch_size, n_batches=n_batches, seed=seed, head=head)
    return L.as_vectors(_dots(centroids, filled, centers, head))
