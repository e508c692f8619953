"""Seeded hashing that gives the same value on every engine, run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HEX_SPAN = float(2**32)


def hash_key(*parts: str | Column, seed: int = 42) -> Column:
    """md5 over ``seed|part|part…`` as 32 hex digits."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hex01(digest: Column, block: int = 0) -> Column:
    """Number ``block`` (0..3) of the four uniform [0, 1) numbers in one digest."""
    digits = F.substring(digest, 8 * block + 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(HEX_SPAN)


def hash01(*parts: str | Column, seed: int = 42) -> Column:
    """Uniform [0, 1) number that depends only on the seed and the parts."""
    return hex01(hash_key(*parts, seed=seed))
