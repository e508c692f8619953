"""Vector bin packing of document groups into shards: bytes, tokens and rows balanced jointly.

Equal texts form a group, and a group stays in one shard. Only a group that no shard could hold, one above the even
share of a shard in bytes, tokens or rows, is split by key into parts of ``HOT_SHARE``. Groups above ``HOT_SHARE`` (at
most 3 / ``HOT_SHARE`` of them, as shares add up to 3) are placed one by one; all others are gathered by hash into
``BUNDLES`` bundles. So the placing sees a bounded number of vectors at any input size; texts never leave their tasks.
Each vector, largest first, goes to the shard with the highest dot product of the vector and the shard's residual
capacity; then vectors move from the fullest to the emptiest shard of the worst balanced dimension, while that brings
the two closer in all dimensions taken together.

Edge cases: a null text has no bytes, size 1 and the checksum of the empty text, and counts as equal to the
empty text; very long texts are only measured; repeated rows are placed one by one, with their group; ties among units go
by their names, among shards to the lowest; a null key is a key; an empty table gives an empty result. Only the named
columns are read, so others can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .dense import numbered

SHARDS = 16
BUNDLES = 1 << 14
HOT_SHARE = 1 / 2048
ROUNDS = 4096
DIMENSIONS = ("size", "tokens", "n")


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size (UTF-8 bytes plus 1), tokens (words between blanks, plus 1), text_crc32 and group (digest of the text)."""
    body = F.coalesce(F.col(text), F.lit(""))
    tokens = F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+"))
    return documents.select(
        key, (F.octet_length(body) + 1).cast("bigint").alias("size"), (tokens + 1).cast("bigint").alias("tokens"),
        F.crc32(body).alias("text_crc32"), F.md5(body).alias("group"))


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of ``vectors`` (units x dimensions)."""
    total = vectors.sum(axis=0)
    scaled = vectors / np.where(total > 0, total, 1) * shards  # a shard's capacity is 1 in each dimension
    residual, out = np.ones((shards, vectors.shape[1])), np.zeros(len(vectors), dtype=np.int32)
    for i in np.lexsort((np.arange(len(vectors)), -scaled.max(axis=1))):
        fits = (residual >= scaled[i]).all(axis=1)
        dot = residual @ scaled[i]
        shard = int(np.argmax(np.where(fits, dot, -np.inf) if fits.any() else dot))
        residual[shard] -= scaled[i]
        out[i] = shard
    return levelled(scaled, residual, out)


def levelled(scaled: np.ndarray, residual: np.ndarray, out: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Move units between the two extreme shards of a dimension while the gap between their residuals, over all dimensions, gets shorter."""
    for _ in range(rounds):
        moved = False
        for d in np.argsort(-np.ptp(residual, axis=0), kind="stable"):
            full, empty = int(np.argmin(residual[:, d])), int(np.argmax(residual[:, d]))
            gap, own = residual[empty] - residual[full], np.flatnonzero(out == full)
            if not len(own):
                continue
            after = ((gap - 2 * scaled[own]) ** 2).sum(axis=1)
            best = int(np.argmin(after))
            if after[best] < (gap ** 2).sum() * (1 - 1e-9):
                residual[full] += scaled[own[best]]
                residual[empty] -= scaled[own[best]]
                out[own[best]] = empty
                moved = True
                break
        if not moved:
            break
    return out


def bucket(value: Column, n) -> Column:
    return F.pmod(F.xxhash64(value), n if isinstance(n, Column) else F.lit(n)).cast("int")


def assign(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` to rows of ``measured`` and number them within it as ``slot``."""
    rows = cut(rows, "measured")
    spark = rows.sparkSession
    groups = cut(rows.groupBy("group").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "groups")
    total = groups.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIMENSIONS]).first()
    share = F.greatest(*[F.col(d) / max(total[d], 1) for d in DIMENSIONS])
    hot = groups.filter(share > HOT_SHARE).select(
        "group", F.when(share > 1 / shards, F.ceil(share / HOT_SHARE)).otherwise(F.lit(1)).cast("int").alias("parts"))
    hot = F.broadcast(cut(hot, "hot"))  # at most 3 / HOT_SHARE rows, as shares add up to 3
    unit = F.when(F.col("parts").isNotNull(), F.concat_ws("/", "group", bucket(F.col(key), F.col("parts")).cast("string")))
    unit = F.coalesce(unit, bucket(F.col("group"), BUNDLES).cast("string"))
    rows = rows.join(hot, "group", "left").withColumn("unit", unit).drop("parts", "group")
    units = rows.groupBy("unit").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")).orderBy("unit").collect()
    vectors = np.array([[u[d] for d in DIMENSIONS] for u in units], dtype=float).reshape(-1, len(DIMENSIONS))
    where = list(zip([u.unit for u in units], place(vectors, shards).tolist(), strict=True)) if units else []
    where = F.broadcast(spark.createDataFrame(where, "unit string, shard int"))  # BUNDLES and the parts of hot groups
    return numbered(rows.join(where, "unit").select(key, "size", "tokens", "text_crc32", "shard"), "shard", "slot")
