"""Near duplicates: ProbMinHash sketches, banding, verification, connected classes.

1. Exact copies fold to one node by the digest of their text, so a text that a third of all rows share costs one node.
2. Each text's sketch of 120 registers gives 24 band keys; texts that share a key are candidates. Two texts
   with similarity 0.8 share a key with probability 0.9999.
3. Candidates are verified by the exact probability Jaccard similarity of 5-word shingles weighted by their counts.
   In buckets of up to ``SMALL`` texts all pairs are (so at most that many for each text); in a larger one, one
   leader is compared with the others first, so n texts give n - 1 pairs. The leader is the member that
   shares most buckets with others: in a group of edited copies this is their common source. Then the leaders leave,
   buckets whose members are in one class are done, and the next leaders follow for at most ``ROUNDS`` rounds or until
   a round links nothing.
4. Buckets that are open after that are split into salted blocks, and blocks are joined with blocks until every pair
   across classes is decided. A large class has blocks of its own, so pairs within it are never formed. A block pair
   bounds all its similarities from above by two matrix products and computes those that can reach the threshold.

Classes are connected components of verified links, and every pair that shares a key is verified, ruled out by the
bound or already in one class. Step 4 grows with the square of a bucket's texts that the leaders could not join.

Edge cases: null texts count as empty; texts without a word are equal only to exact copies; texts of fewer than five
words are one shingle; repeated rows are copies; null keys pass through; an empty table gives an empty result; very long texts are
compared whole, a few at a time, so the longest pair bounds a task's memory; of equal scores the largest digest leads, which changes
the pairs tested but not the classes; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import cut
from . import sketches as S
from .components import components
from .textarrays import buffers, groups

BANDS = 24
THRESHOLD = 0.8
SMALL = 32
ROUNDS = 4
#: Texts and bytes of one block of an open bucket, and shingles in one matrix product.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 4 << 20, 1 << 14


def sketched(documents: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS) -> DataFrame:
    """(``key``, node, bands): the digest of the text and its band keys (none without a word)."""
    schema = T.StructType([T.StructField(key, documents.schema[key].dataType), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in groups(batch, text):
                n = part.num_rows
                data, offsets = buffers(part.column(1))
                owner, ids, weights = S.bags(data, offsets)
                keys = S.band_keys(S.sketches(owner, ids, weights, n), bands)
                has = np.zeros(n, dtype=bool)
                has[owner] = True
                at = pa.array(np.concatenate(([0], np.cumsum(has * bands))), pa.int32())
                whole = data.tobytes()
                nodes = [hashlib.md5(whole[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(at, pa.array(keys[has].ravel()))], names=schema.names)

    return documents.select(key, text).mapInArrow(sketch, schema)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v, cu, cv, similarity) of node pairs (u, v, cu, cv); ``texts`` has (node, text)."""
    right = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("right")), "v")
    whole = right.join(texts.select(F.col("node").alias("u"), F.col("text").alias("left")), "u").select("u", "v", "left", "right", "cu", "cv")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in groups(batch, "left"):
                for part in groups(half, "right"):
                    n = part.num_rows
                    sides = []
                    for column in (2, 3):
                        owner, ids, weights = S.bags(*buffers(part.column(column)))
                        at = np.searchsorted(owner, np.arange(n + 1))
                        sides.append([(ids[a:b], weights[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)])
                    found = [S.similarity(a, b) for a, b in zip(*sides, strict=True)]
                    yield pa.RecordBatch.from_arrays([*[part.column(i) for i in (0, 1, 4, 5)], pa.array(found, pa.float64())], names=["u", "v", "cu", "cv", "similarity"])

    return whole.mapInArrow(compare, "u binary, v binary, cu binary, cv binary, similarity double")


def candidates(rows: DataFrame, tops: DataFrame | None) -> DataFrame:
    """Pairs across classes of ``rows`` (key, node, component): each with its bucket's leader, or all if there is none."""
    if tops is None:
        other = rows.select("key", F.col("node").alias("other"), F.col("component").alias("there"))
        pairs = rows.join(other, "key").filter("node < other")
    else:
        pairs = rows.join(tops, "key").select("node", "component", F.col("top.node").alias("other"), F.col("top.component").alias("there"))
    return pairs.filter("component <> there").select(
        F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v"), F.col("component").alias("cu"), F.col("there").alias("cv"))


def most_similar(left: list, right: list) -> np.ndarray:
    """Upper bounds of the similarities of all bags of ``left`` with all of ``right``.

    With P and Q the shares of two bags' weights on shingles that both have, it is at most half of P / (2 - P) + Q / (2 - Q).
    """
    columns = np.intersect1d(np.concatenate([ids for ids, _ in left]), np.concatenate([ids for ids, _ in right]))
    mine, theirs = np.zeros((2, len(left), len(right)), dtype=np.float32)
    for start in range(0, len(columns), COLUMNS):
        part = columns[start:start + COLUMNS]
        dense = []
        for side in (left, right):
            shares = np.zeros((len(side), len(part)), dtype=np.float32)
            for row, (ids, weights) in enumerate(side):
                a, b = np.searchsorted(ids, part[0]), np.searchsorted(ids, part[-1], side="right")
                at = np.minimum(np.searchsorted(part, ids[a:b]), len(part) - 1)
                there = part[at] == ids[a:b]
                shares[row, at[there]] = weights[a:b][there] / weights.sum()
            dense.append((shares, (shares > 0).astype(np.float32)))
        mine += dense[0][0] @ dense[1][1].T
        theirs += dense[0][1] @ dense[1][0].T
    return (mine / (2 - mine) + theirs / (2 - theirs)) / 2


def block_links(rows: pa.Table, threshold: float) -> list[tuple[int, int]]:
    """Row pairs with a link, enough to join all classes that links join; ``rows`` has (right, component, text)."""
    bags = []
    for batch in rows.select(["text"]).combine_chunks().to_batches():
        for part in groups(batch, "text"):
            owner, ids, weights = S.bags(*buffers(part.column(0)))
            at = np.searchsorted(owner, np.arange(part.num_rows + 1))
            bags += [(ids[a:b], weights[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    right = rows["right"].to_numpy().astype(bool)
    _, classes = np.unique(np.array(rows["component"].to_pylist(), dtype=object), return_inverse=True)
    two = right.any()
    at, to = (np.flatnonzero(~right), np.flatnonzero(right)) if two else (np.arange(len(bags)), np.arange(len(bags)))
    if not len(at) or not len(to):
        return []
    bounds = most_similar([bags[i] for i in at], [bags[j] for j in to])
    able = (bounds >= threshold - 1e-3) & (classes[at][:, None] != classes[to][None, :])  # products are in single precision
    u, v = np.nonzero(able if two else np.triu(able, 1))
    order = np.argsort(-bounds[u, v], kind="stable")
    links = []
    for i, j in zip(at[u[order]].tolist(), to[v[order]].tolist(), strict=True):
        if classes[i] != classes[j] and S.similarity(bags[i], bags[j]) >= threshold:
            links.append((i, j))
            classes[classes == classes[j]] = classes[i]
    return links


def across_blocks(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(u, v): links that join all classes of ``rows`` (key, node, component) which links within a bucket join."""
    sized = rows.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    share = F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)
    by_class = sized.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    by_class = by_class.withColumn("own", F.when(share > 1, F.col("component")))
    by_own = by_class.groupBy("key", "own").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    parts = by_class.select("key", "component", "own").alias("c").join(
        by_own.select("key", "own", F.ceil(share).alias("parts")).alias("o"),
        (F.col("c.key") == F.col("o.key")) & F.col("c.own").eqNullSafe(F.col("o.own"))).select("c.key", "component", "c.own", "parts")
    salted = rows.join(parts, ["key", "component"]).select(
        "key", "node", "component", F.xxhash64("own", F.pmod(F.xxhash64("node"), "parts")).alias("block"))
    salted = cut(salted, "salted")
    blocks = salted.groupBy("key", "block").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    others = blocks.select("key", *[F.col(c).alias(f"{c}_2") for c in ("block", "least", "most")])
    pairs = blocks.join(others, "key").filter("block <= block_2 and (least < most or least_2 < most_2 or least <> least_2)")
    pairs = cut(pairs.select("key", F.col("block").alias("a"), F.col("block_2").alias("b")), "block_pairs")
    left = pairs.select("key", F.col("a").alias("block"), "a", "b", F.lit(0).alias("right"))
    sides = left.unionByName(pairs.filter("a < b").select("key", F.col("b").alias("block"), "a", "b", F.lit(1).alias("right")))
    whole = salted.join(texts, "node").join(sides, ["key", "block"]).select("key", "a", "b", "right", "node", "component", "text")

    def link(rows: pa.Table) -> pa.Table:
        nodes, links = rows["node"].to_pylist(), block_links(rows, threshold)
        return pa.table({name: pa.array([nodes[pair[side]] for pair in links], pa.binary()) for side, name in enumerate("uv")})

    return cut(whole.groupBy("key", "a", "b").applyInArrow(link, "u binary, v binary"), "block_links")


def linked_nodes(buckets: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the nodes that have a verified link; ``buckets`` has (key, n, node, score), n nodes a key and two at least."""
    rows = buckets.withColumn("component", F.col("node"))
    large = rows.filter(F.col("n") > SMALL).drop("n")
    pairs, tested = candidates(rows.filter(F.col("n") <= SMALL), None), None
    for _ in range(ROUNDS):
        tops = large.groupBy("key").agg(F.max(F.struct("score", "node", "component")).alias("top"),
                                        (F.min("component") < F.max("component")).alias("open")).filter("open").drop("open")
        tops = cut(tops, "leaders")
        by_leader = candidates(large, tops)
        pairs = (by_leader if pairs is None else pairs.unionByName(by_leader)).dropDuplicates(["u", "v"])
        if tested is not None:
            pairs = pairs.join(tested.select("u", "v"), ["u", "v"], "left_anti")
        found = cut(verified(pairs, texts).withColumn("linked", F.col("similarity") >= threshold), "verified")
        tested = found if tested is None else tested.unionByName(found)
        new = found.filter("linked")
        linking = new.limit(1).count()
        remaining = large.join(tops, "key").filter(F.col("node") != F.col("top.node")).drop("top")
        if linking:
            moved = components(new.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
            moved = moved.select(F.col("node").alias("component"), F.col("component").alias("now"))
            remaining = remaining.join(moved, "component", "left").select("key", "node", "score", F.coalesce("now", "component").alias("component"))
        large = cut(remaining, "large")
        pairs = None
        if not linking or not large.limit(1).count():
            break
    links = tested.filter("linked").select("u", "v")
    still = large.groupBy("key").agg((F.min("component") < F.max("component")).alias("open")).filter("open").drop("open")
    left = cut(large.join(still, "key").select("key", "node", "component"), "open")
    if left.limit(1).count():
        links = links.unionByName(across_blocks(left, texts, threshold))
    return components(links)


def node_of(text: Column) -> Column:
    """The digest by which equal texts are one node."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def members(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(``key``, node, component, class_id) for every row: its text's node, the least node and the least key of its class."""
    rows = cut(sketched(documents, key, text, bands), "sketched")
    nodes = cut(rows.groupBy("node").agg(F.min(key).alias("rep"), F.first("bands").alias("bands")), "nodes")
    exploded = nodes.select("node", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = cut(exploded.join(shared, "key"), "buckets")
    scores = cut(buckets.groupBy("node").agg(F.sum("n").alias("score")), "scores")
    needed = scores.select("node").join(nodes.select("node", "rep"), "node")
    bodies = documents.select(F.col(key).alias("rep"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fetched = bodies.join(needed, bodies["rep"].eqNullSafe(needed["rep"])).select("node", bodies["text"])
    texts = cut(fetched.filter(node_of(F.col("text")) == F.col("node")).dropDuplicates(["node"]), "texts")
    found = linked_nodes(cut(buckets.join(scores, "node"), "scored"), texts, threshold)
    owned = cut(nodes.join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component")), "owned")
    least = owned.groupBy("component").agg(F.min("rep").alias("class_id"))
    by_node = cut(owned.join(least, "component").select("node", "component", "class_id"), "by_node")
    return rows.select(key, "node").join(by_node, "node").select(key, "node", "component", "class_id")


def classes(documents: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(``key``, class_id) for every row: the least key among the copies and near copies of its text."""
    return members(documents, key, **options).select(key, "class_id")


def firsts(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, all columns: the one with the least key (of several such texts, the least digest)."""
    own = members(documents, key, text, **options).filter(F.col(key).eqNullSafe(F.col("class_id")))
    counts = own.groupBy("component", "node").agg(F.first(key).alias("_key"), F.count("*").alias("_n"))
    chosen = cut(counts.groupBy("component").agg(F.min(F.struct("node", "_key", "_n")).alias("_first")).select("_first.*"), "firsts")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col(key).alias("_own"), node_of(F.col(text)).alias("_node"))
    kept = rows.join(chosen, (F.col("_node") == F.col("node")) & F.col("_own").eqNullSafe(F.col("_key")))
    if chosen.filter("_n > 1").limit(1).count():  # rows that are there several times
        kept = kept.filter("_n = 1").unionByName(kept.filter("_n > 1").dropDuplicates(["_node"]))
    return kept.select("_row.*")
