"""Vocabulary statistics and window weights: TF-IDF, counts, hashed terms, plain IDF."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from ..session import cut, parts_for

HEAD_TERMS = 262_144  # most frequent terms of the windows whose idf is broadcast
WINDOW_KEYS = ("word", "doc_id", "line_no", "offset")


def doc_freq(lines: DataFrame, *, tokenizer=T.tokenize) -> DataFrame:
    """``(term, df)``: lines that contain the term.

    Repeats are removed inside the row, so the only shuffle carries per-task counts.
    """
    terms = F.explode(F.array_distinct(tokenizer(F.col("line")))).alias("term")
    return lines.select(terms).groupBy("term").agg(F.count("*").alias("df"))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + F.lit(1.0)) / (df + F.lit(1.0))) + F.lit(1.0)


def vocabulary(lines: DataFrame, *, stop: list[str] | None = None, min_df: int = 1,
               max_df: float = 1.0, tokenizer=T.tokenize) -> DataFrame:
    """``(term, df, idf)`` without stop words, too rare and too common terms."""
    n = lines.agg(F.count("*").cast("double").alias("n")).scalar()
    terms = doc_freq(lines, tokenizer=tokenizer)
    if stop:
        terms = terms.filter(~F.col("term").isin(stop))
    if min_df > 1:
        terms = terms.filter(F.col("df") >= min_df)
    if max_df < 1.0:
        terms = terms.filter(F.col("df") <= F.lit(max_df) * n)
    return terms.withColumn("idf", smooth_idf(n, F.col("df")))


def vocab_size(lines: DataFrame, *, approximate: bool = False, tokenizer=T.tokenize) -> DataFrame:
    """Number of distinct words; the approximate form keeps one sketch per task."""
    words = lines.select(F.explode(tokenizer(F.col("line"))).alias("word"))
    count = F.approx_count_distinct("word") if approximate else F.count_distinct("word")
    return words.agg(count.alias("vocab_size"))


def windows_per_word(posts: DataFrame) -> DataFrame:
    return posts.groupBy("word").agg(F.count("*").alias("n_windows"))


def window_terms(windows: DataFrame, *, keys: tuple[str, ...] = WINDOW_KEYS, keep_empty: bool = False) -> DataFrame:
    """``(keys…, term, tf)``; ``keep_empty`` leaves one row with no term for an empty window."""
    explode = F.explode_outer if keep_empty else F.explode
    return (
        windows.select(*keys, explode("window").alias("term"))
        .groupBy(*keys, "term").agg(F.count("term").alias("tf"))
    )


class Dealt(NamedTuple):
    """Written windows and how they are shuffled: by which columns and into how many partitions.

    The number follows from the count of windows, as adaptive execution would size a partition by its compressed
    windows and not by the terms that they are taken apart to.
    """
    windows: DataFrame
    by: tuple[str, ...]
    parts: int

    def rows(self) -> DataFrame:
        return self.windows.repartition(self.parts, *self.by)


def deal(windows: DataFrame, *by: str) -> Dealt:
    windows = cut(windows, "windows")
    return Dealt(windows, by, parts_for(windows))


def known_terms(dealt: Dealt, rows: DataFrame, vocab: DataFrame, *, keys: tuple[str, ...], keep_empty: bool) -> DataFrame:
    """``(keys…, term, tf, idf)`` of the dealt ``rows``, still dealt alike; ``keep_empty`` adds a row without term to each window.

    Terms meet the vocabulary before they are counted. A large vocabulary is not joined with all terms: the idf of the
    windows' most frequent terms, or that there is none, is broadcast, and only other terms travel to the vocabulary and back.
    """
    vocab = cut(vocab.select("term", "idf"), "idf")
    each = F.explode_outer(F.array_append("window", F.lit(None).cast("string"))) if keep_empty else F.explode("window")
    terms = rows.select(*keys, each.alias("term"))

    def counted(known: DataFrame) -> DataFrame:
        term = F.when(F.col("idf").isNotNull(), F.col("term"))
        known = known.join(F.broadcast(vocab if head is None else head), "term", "left")
        known = known.filter(F.col("idf").isNotNull() | F.lit(keep_empty))
        return known.groupBy(*keys, term.alias("term")).agg(F.count(term).alias("tf"), F.max("idf").alias("idf"))

    head = None
    if vocab.count() <= HEAD_TERMS:
        return counted(terms)
    counts = dealt.windows.select(F.explode("window").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    head = cut(counts.orderBy(F.desc("n"), "term").limit(HEAD_TERMS).select("term").join(vocab, "term", "left"), "head")
    far = terms.join(F.broadcast(head.select("term")), "term", "left_anti").filter(F.col("term").isNotNull())
    far = far.groupBy(*keys, "term").agg(F.count("term").alias("tf")).join(vocab, "term").select(*keys, "term", "tf", "idf")
    return counted(terms).unionByName(far.repartition(dealt.parts, *dealt.by))


def count_windows(windows: DataFrame, vocab: DataFrame, *, keys: tuple[str, ...] = WINDOW_KEYS,
                  keep_empty: bool = False, dealt: Dealt | None = None) -> DataFrame:
    """Raw counts of vocabulary terms per window; ``dealt`` tells how ``windows`` were shuffled already."""
    if dealt is None:
        windows = (dealt := deal(windows.select(*keys, "window"), *keys)).rows()
    terms = known_terms(dealt, windows, vocab.select("term", F.lit(1.0).alias("idf")), keys=keys, keep_empty=keep_empty)
    if not keep_empty:
        return terms.select(*keys, "term", "tf")
    return terms.select(*keys, "term", F.col("tf").cast("double").alias("weight"))


def tfidf_windows(windows: DataFrame, vocab: DataFrame, *, keys: tuple[str, ...] = WINDOW_KEYS,
                  sublinear: bool = True, keep_empty: bool = False, dealt: Dealt | None = None) -> DataFrame:
    """``(keys…, term, tf, weight)`` with unit length per window.

    ``vocab`` is any ``(term, idf)`` table, fitted here or loaded from elsewhere; ``dealt`` tells how ``windows``
    were shuffled already.
    """
    if dealt is None:
        windows = (dealt := deal(windows.select(*keys, "window"), *keys)).rows()
    rows = known_terms(dealt, windows, vocab, keys=keys, keep_empty=keep_empty)
    tf = F.col("tf").cast("double")
    raw = (F.lit(1.0) + F.log(tf) if sublinear else tf) * F.col("idf")
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*keys)))
    weighted = rows.withColumn("raw", raw).withColumn("norm", norm)
    return weighted.select(
        *keys, "term", "tf",
        F.coalesce(F.col("raw") / F.col("norm"), F.lit(0.0)).alias("weight"))


def dealt_tfidf(windows: DataFrame, vocab: DataFrame, *, keys: tuple[str, ...] = WINDOW_KEYS) -> DataFrame:
    """``tfidf_windows`` with empty windows, dealt by word: for sampled windows, of which a word has a bounded number."""
    dealt = deal(windows.select(*keys, "window"), "word")
    return tfidf_windows(dealt.rows(), vocab, keys=keys, keep_empty=True, dealt=dealt)


def hashed_terms(windows: DataFrame, *, num_features: int = 1024,
                 keys: tuple[str, ...] = WINDOW_KEYS, dealt: bool = False) -> DataFrame:
    """``(keys…, bucket, tf)``: term counts per md5 bucket.

    Whole windows are dealt by their keys and taken apart after that, so no row per term is shuffled. Windows whose
    lines are ``dealt`` by some of the keys stay where they are.
    """
    digits = F.substring(F.md5("term"), 1, 8)
    bucket = (F.conv(digits, 16, 10).cast("bigint") % num_features).cast("int")
    return (
        (windows.select(*keys, "window") if dealt else windows.select(*keys, "window").repartition(*keys))
        .select(*keys, F.explode("window").alias("term")).groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("tf"))
    )


def plain_idf(hashed: DataFrame, windows: DataFrame) -> DataFrame:
    """``(bucket, df, idf)`` with ln((m + 1) / (df + 1)), documents being windows."""
    m = windows.agg(F.count("*").cast("double").alias("m")).scalar()
    return hashed.groupBy("bucket").agg(F.count("*").alias("df")).withColumn(
        "idf", F.log((m + 1.0) / (F.col("df") + F.lit(1.0))))
