"""Centered windows for predicting the middle item: token runs and shingle runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A, text as T


def token_windows(lines: DataFrame, *, size: int = 5, stop: list[str] | None = None,
                  ascii_only: bool = False, exclude_center: bool = True,
                  keys: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """``(keys…, pos, word, window)`` for every complete run of ``size`` clean tokens."""
    size = A.odd_size(size)
    toks: Column = T.remove_stop_words(
        T.tokenize_ws(T.clean_text(F.col("line"), ascii_only=ascii_only)), stop or [])
    rows = lines.select(*keys, toks.alias("toks")).select(
        *keys, F.posexplode(A.centered(F.col("toks"), size)).alias("pos", "run"))
    return _label(rows, keys, exclude_center)


def shingle_windows(lines: DataFrame, *, ngram: int = 3, size: int = 7, exclude_center: bool = True,
                    keys: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """``(keys…, pos, word, window)`` for runs of character shingles; short text gives one."""
    text = T.clean_text_short(F.col("line"))
    rows = lines.select(*keys, T.char_ngrams(text, ngram).alias("grams")).select(
        *keys, F.posexplode(A.centered_or_partial(F.col("grams"), size)).alias("pos", "run"))
    return _label(rows, keys, exclude_center)


def _label(rows: DataFrame, keys: tuple[str, ...], exclude_center: bool) -> DataFrame:
    window = A.without_middle(F.col("run")) if exclude_center else F.col("run")
    return rows.select(*keys, "pos", A.middle(F.col("run")).alias("word"), window.alias("window"))
