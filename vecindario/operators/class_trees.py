"""One-vs-rest decision trees, grown for all classes together, level by level.

A level is a fixed number of jobs whatever the number of classes. The tree of a class needs, in each of its nodes, the
positive rows by (bucket, bin), which are few in all since a row is positive in one tree only, and all rows by
(bucket, bin). Nodes with the same conditions in different trees share that second count, it is taken over rows only for
the branch above a threshold, which a sparse row enters by one of its own buckets, and the branch below is the
parent minus that. So no row is ever paired with every class, neither here nor in ``predict``.

Splits are those of Spark ML's trees: Gini gain, thresholds half way between neighbouring values, the lowest bucket and
threshold among equal gains. A row belongs to the class whose leaf has the largest share of positives; ties go to the leaf
with more positives, then to the first word.

A null feature list has only zeros, and a bucket that is listed twice counts with the sum; a null word is no class but is
negative for all; repeated rows weigh as often as they stand there; values are not negative; without a class every
prediction is null; an empty table gives an empty result. A row's features are one value, so a row bounds their memory.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

MAX_DEPTH, MAX_BINS = 5, 32
FEATURES = "array<struct<bucket: int, value: double>>"
CELLS = "map<int, int>"
PATH = "array<struct<bucket: int, bin: int, above: boolean>>"


@dataclass
class Model:
    leaves: DataFrame  # word, path, n: training rows, p: positive ones
    edges: DataFrame  # bucket, edges: the thresholds between its bins


def hashed(terms: str, num_features: int) -> Column:
    """Counts of the terms by hash bucket, as ``FEATURES``."""
    buckets = F.transform(F.coalesce(F.col(terms), F.lit([]).cast("array<string>")), lambda t: F.pmod(F.hash(t), F.lit(num_features)))
    counted = F.transform(F.array_distinct(buckets), lambda b: F.struct(
        b.cast("int").alias("bucket"), F.size(F.filter(buckets, lambda c: c == b)).cast("double").alias("value")))
    return counted.cast(FEATURES)


def thresholds(rows: DataFrame, features: str, max_bins: int) -> DataFrame:
    """(bucket, edges): half way between neighbouring values, or at equal shares of the rows where there are more than ``max_bins``."""
    entries = rows.select(F.explode(features).alias("e")).select("e.*").filter("value > 0")
    values = entries.groupBy("bucket", "value").agg(F.count("*").alias("n"))
    up = Window.partitionBy("bucket").orderBy("value")
    all_of = Window.partitionBy("bucket")
    share = F.floor((F.sum("n").over(up) - F.col("n")) * (max_bins - 1) / F.sum("n").over(all_of))
    placed = values.select("bucket", "value", F.lag("value", 1, 0.0).over(up).alias("before"),
                           F.when(F.count("*").over(all_of) < max_bins, F.row_number().over(up)).otherwise(share).alias("part"))
    firsts = placed.groupBy("bucket", "part").agg(F.min(F.struct("value", "before")).alias("first"))
    return firsts.groupBy("bucket").agg(F.sort_array(F.collect_list((F.col("first.value") + F.col("first.before")) / 2)).alias("edges"))


def binned(rows: DataFrame, edges: DataFrame, features: str) -> DataFrame:
    """(``id``, cells) per row of (id, features): the bin of each bucket whose value lies above its first threshold."""
    entries = rows.select("id", F.explode(features).alias("e")).select("id", "e.*").join(edges, "bucket")
    bins = F.size(F.filter("edges", lambda edge: edge < F.col("value"))).alias("bin")
    held = entries.select("id", "bucket", bins).filter("bin > 0")
    return held.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "bin")))).alias("cells"))


def summed(features: str) -> Column:
    """The features with each bucket once."""
    given = F.coalesce(F.col(features).cast(FEATURES), F.lit([]).cast(FEATURES))
    return F.transform(F.array_sort(F.array_distinct(given["bucket"])), lambda b: F.struct(b.alias("bucket"), F.aggregate(
        F.filter(given, lambda e: e["bucket"] == b), F.lit(0.0), lambda total, e: total + e["value"]).alias("value")))


def numbered_bags(rows: DataFrame, features: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with the number ``id`` of their features, and (id, features) once for all equal ones."""
    held = cut(rows.withColumn("_bag", summed(features)), f"{name}_rows")
    bags = cut(held.select("_bag").distinct().withColumn("id", F.monotonically_increasing_id()), f"{name}_bags")  # written once, so fixed
    return held.join(bags, "_bag").drop("_bag"), bags.withColumnRenamed("_bag", "features")


def meets(path: str, cells: str = "cells") -> Column:
    """Whether a row with these cells meets every condition of the path; a bucket that it lacks is in bin 0."""
    return F.forall(path, lambda c: (F.coalesce(F.try_element_at(F.col(cells), c["bucket"]), F.lit(0)) > c["bin"]) == c["above"])


def step(above: bool) -> Column:
    return F.concat("path", F.array(F.struct(F.col("bucket"), F.col("bin"), F.lit(above).alias("above")))).cast(PATH)


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys…, bucket, bin, n) of rows with cells and a weight n."""
    return rows.select(*keys, "n", F.explode("cells").alias("bucket", "bin")).groupBy(*keys, "bucket", "bin").agg(F.sum("n").alias("n"))


def impurity(p: Column, n: Column) -> Column:
    no, yes = (n - p) / n, p / n
    return F.lit(1.0) - no * no - yes * yes


def best_splits(nodes: DataFrame, total: DataFrame, positive: DataFrame) -> DataFrame:
    """Nodes (word, path, n, p) with the split of the largest gain: bucket, bin, and n and p above it."""
    rows_of = total.groupBy("path", "bucket").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
    own = positive.groupBy("word", "path", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("bin", F.col("n").alias("p")))).alias("own"))
    cells = nodes.join(rows_of, "path").join(own, ["word", "path", "bucket"], "left")
    cells = cells.withColumn("own", F.coalesce("own", F.map_from_arrays(F.lit([]).cast("array<int>"), F.lit([]).cast("array<bigint>"))))
    # One candidate for each bin that the node holds: the rows of that bin and above; the threshold lies right above the next lower bin.
    tried = F.expr("""transform(sequence(1, size(bins)), i -> struct(
        if(i < size(bins), get(bins, i).bin, 0) as bin,
        aggregate(slice(bins, 1, i), 0L, (s, b) -> s + b.n) as up_n,
        aggregate(slice(bins, 1, i), 0L, (s, b) -> s + coalesce(try_element_at(own, b.bin), 0L)) as up_p))""")
    found = cells.select("word", "path", "n", "p", "bucket", F.explode(tried).alias("s")).select("word", "path", "n", "p", "bucket", "s.*")
    found = found.filter("up_n < n")
    low_n, low_p = F.col("n") - F.col("up_n"), F.col("p") - F.col("up_p")
    gain = (impurity(F.col("p"), F.col("n")) - low_n / F.col("n") * impurity(low_p, low_n)
            - F.col("up_n") / F.col("n") * impurity(F.col("up_p"), F.col("up_n")))
    found = found.withColumn("minus", -gain).filter("minus < 0")
    best = found.groupBy("word", "path", "n", "p").agg(F.min(F.struct("minus", "bucket", "bin", "up_n", "up_p")).alias("best"))
    return best.select("word", "path", "n", "p", "best.bucket", "best.bin", "best.up_n", "best.up_p")


def fit(train: DataFrame, *, word: str = "word", features: str = "features", max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS) -> Model:
    """The leaves of one binary tree for each word."""
    rows, bags = numbered_bags(train.select(F.col(word).alias("word"), F.col(features).alias("features")), "features", "train")
    rows = cut(rows.select("word", "id"), "train")
    # Thresholds count rows, so they come from the rows and not from the distinct bags.
    edges = cut(thresholds(rows.join(bags, "id"), "features", max_bins), "edges")
    counted = rows.groupBy("id", "word").agg(F.count("*").alias("n"))
    no_cells = F.map_from_arrays(F.lit([]).cast("array<int>"), F.lit([]).cast("array<int>"))
    counted = counted.join(binned(bags, edges, "features"), "id", "left").withColumn("cells", F.coalesce("cells", no_cells))
    counted = cut(counted, "counted")
    everything = cut(counted.groupBy("id").agg(F.sum("n").alias("n"), F.first("cells").alias("cells")), "weighted")
    root = F.lit([]).cast(PATH)
    size = everything.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    classes = counted.filter("word is not null").groupBy("word").agg(F.sum("n").alias("p"))
    nodes = cut(classes.select("word", root.alias("path"), F.lit(size).cast("long").alias("n"), "p"), "nodes")
    total = cut(histogram(everything.withColumn("path", root), "path"), "total")
    placed = counted.filter("word is not null").withColumn("path", root)
    done = []
    for _ in range(max_depth):
        impure = nodes.filter("0 < p and p < n")
        splits = cut(best_splits(impure, total, histogram(placed, "word", "path")), "splits")
        done.append(nodes.join(splits.select("word", "path"), ["word", "path"], "left_anti"))
        above = splits.select("word", step(True).alias("path"), F.col("up_n").alias("n"), F.col("up_p").alias("p"))
        below = splits.select("word", step(False).alias("path"), (F.col("n") - F.col("up_n")).alias("n"), (F.col("p") - F.col("up_p")).alias("p"))
        nodes = cut(above.unionByName(below), "nodes")
        if nodes.isEmpty():
            break
        placed = placed.join(splits.select("word", "path", "bucket", "bin"), ["word", "path"])
        up = F.coalesce(F.try_element_at("cells", F.col("bucket")), F.lit(0)) > F.col("bin")
        placed = cut(placed.withColumn("path", F.when(up, step(True)).otherwise(step(False))).drop("bucket", "bin"), "placed")
        total = cut(children(splits, total, everything), "total")
    return Model(cut(collected([*done, nodes]), "leaves"), edges)


def collected(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def children(splits: DataFrame, total: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, bucket, bin, n) of all rows in the nodes below ``splits``: counted above a threshold, subtracted below it."""
    shared = cut(splits.select("path", "bucket", "bin").distinct(), "shared")
    entries = rows.select("n", "cells", F.explode("cells").alias("bucket", "own"))
    entered = entries.join(shared, "bucket").filter((F.col("own") > F.col("bin")) & meets("path"))
    above = cut(histogram(entered.select(step(True).alias("path"), "n", "cells"), "path"), "above")
    parent = shared.withColumnsRenamed({"bucket": "at", "bin": "edge"}).join(total, "path")
    last = F.struct(F.col("at").alias("bucket"), F.col("edge").alias("bin"), F.lit(False).alias("above"))
    below = parent.select(F.concat("path", F.array(last)).cast(PATH).alias("path"), "bucket", "bin", "n")
    size = F.size("path") - 1
    sibling = F.concat(F.slice("path", F.lit(1), size), F.array(F.struct(
        F.element_at("path", -1)["bucket"].alias("bucket"), F.element_at("path", -1)["bin"].alias("bin"), F.lit(False).alias("above")))).cast(PATH)
    taken = above.select(sibling.alias("path"), "bucket", "bin", (-F.col("n")).alias("n"))
    rest = below.unionByName(taken).groupBy("path", "bucket", "bin").agg(F.sum("n").alias("n")).filter("n > 0")
    return above.unionByName(rest)


def reached(bags: DataFrame, leaves: DataFrame) -> DataFrame:
    """(id, and the leaf's columns) for the leaves with a condition above a threshold that the rows (id, cells) reach."""
    entry = F.get(F.filter("path", lambda c: c["above"]), F.lit(0))
    indexed = leaves.filter(F.exists("path", lambda c: c["above"])).withColumn("bucket", entry["bucket"]).withColumn("least", entry["bin"])
    entries = bags.select("id", "cells", F.explode("cells").alias("bucket", "own"))
    return entries.join(indexed, "bucket").filter((F.col("own") > F.col("least")) & meets("path")).drop("cells", "bucket", "own", "least", "path")


def predict(rows: DataFrame, model: Model, *, features: str = "features") -> DataFrame:
    """Add ``pred_word`` and ``share``, the share of positives in its leaf.

    Every tree has one leaf below all thresholds on its way. A row is there in all trees but those where it reaches another
    leaf, so the best of these leaves is the first in their order that the row does not leave.
    """
    kept = [c for c in rows.columns if c not in ("pred_word", "share")]
    held, bags = numbered_bags(rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(features).alias("features")), "features", "asked")
    rank = F.struct((-(F.col("p") / F.col("n"))).alias("minus"), (-F.col("p")).alias("less"), "word")
    leaves = model.leaves.withColumn("rank", rank)
    low = leaves.filter(F.forall("path", lambda c: ~c["above"])).select("word", "rank")
    parts = low.sparkSession.sparkContext.defaultParallelism
    ordered = cut(low.repartitionByRange(parts, "rank").sortWithinPartitions("rank").withColumn("part", F.spark_partition_id()), "low")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("size"))  # one row for each partition
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("rank")) - 1
    low = cut(ordered.join(F.broadcast(starts), "part").select("word", "rank", place.alias("place")), "places")
    found = cut(reached(binned(bags, model.edges, "features"), leaves.join(low.select("word", "place"), "word", "left")), "reached")
    # The first place that is not left: walk the sorted places that are.
    free = F.aggregate(F.array_sort(F.collect_set("place")), F.lit(0).cast("long"), lambda at, left: F.when(left == at, at + 1).otherwise(at))
    by_bag = found.groupBy("id").agg(F.min("rank").alias("other"), free.alias("place"))
    best = bags.select("id").join(by_bag, "id", "left").withColumn("place", F.coalesce("place", F.lit(0)))
    best = best.join(low.select("place", F.col("rank").alias("common")), "place", "left")
    best = best.withColumn("best", F.least("other", "common")).select("id", F.col("best.word").alias("pred_word"), (-F.col("best.minus")).alias("share"))
    return held.join(best, "id").select("_row.*", "pred_word", "share")
