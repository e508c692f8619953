"""Array expressions for token windows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def odd_size(size: int) -> int:
    """Window sizes are odd so that a middle exists; even sizes grow by one."""
    if size < 1:
        raise ValueError("window size must be positive")
    return size if size % 2 else size + 1


def around(tokens: Column, offset: Column, wsize: int) -> Column:
    """Up to ``wsize`` items on each side of 0-based ``offset``, without that item."""
    left = F.slice(tokens, F.greatest(F.lit(1), offset - (wsize - 1)), F.least(offset, F.lit(wsize)))
    right = F.slice(tokens, offset + 2, F.lit(wsize))
    return F.concat(left, right)


def centered(tokens: Column, size: int) -> Column:
    """Every complete run of ``size`` items; none when the array is shorter."""
    last = F.size(tokens) - (size - 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)),
                       lambda i: F.slice(tokens, i, F.lit(size)))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<array<string>>"))


def centered_or_partial(items: Column, size: int) -> Column:
    """Like ``centered``, but a short, non-empty array gives one partial window."""
    return (
        F.when(F.size(items) >= size, centered(items, size))
        .when(F.size(items) > 0, F.array(items))
        .otherwise(F.array().cast("array<array<string>>"))
    )


def middle(window: Column) -> Column:
    return F.element_at(window, F.floor(F.size(window) / 2).cast("int") + 1)


def without_middle(window: Column) -> Column:
    half = F.floor(F.size(window) / 2).cast("int")
    return F.concat(F.slice(window, F.lit(1), half), F.slice(window, half + 2, F.size(window)))
