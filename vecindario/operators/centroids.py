"""Word centroids: the mean weight vector of the sampled windows of a word.

The word × term matrix stays in long form ``(word, term, weight, n_windows)``. A word
whose windows hold no vocabulary term keeps one row with a null term and weight 0, so
that it still gets a (zero) vector.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..session import cut
from . import postings as P, weights as Wt


def mean_by_word(weighted: DataFrame) -> DataFrame:
    """``(word, term, weight, n_windows)`` from per-window weights that carry ``n_windows``."""
    means = weighted.groupBy("word", "term").agg(
        (F.sum("weight") / F.max("n_windows")).alias("weight"), F.max("n_windows").alias("n_windows"))
    terms = F.count("term").over(Window.partitionBy("word"))
    return (
        means.withColumn("n_terms", terms)
        .filter(F.col("term").isNotNull() | (F.col("n_terms") == 0))
        .drop("n_terms")
    )


def count_per_word(windows: DataFrame) -> DataFrame:
    """Attach the number of windows of the word to each of its windows."""
    return windows.withColumn("n_windows", F.count("*").over(Window.partitionBy("word")))


def word_centroids(windows: DataFrame, vocab: DataFrame, *, weighting: str = "tfidf",
                   by_word: bool = True,
                   keys: tuple[str, ...] = Wt.WINDOW_KEYS) -> DataFrame:
    """Mean TF-IDF (or ``counts``) vector per word, over all its sampled windows.

    With sampled windows a word has a bounded number of rows, so one shuffle by word
    (``by_word``) serves the window norm and the mean alike. Pass ``by_word=False`` for
    unsampled windows, where a frequent word may hold a large part of all rows.
    """
    if weighting not in ("tfidf", "counts"):
        raise ValueError("weighting is 'tfidf' or 'counts'")
    weigh = Wt.tfidf_windows if weighting == "tfidf" else Wt.count_windows
    if by_word:
        dealt = Wt.deal(windows.select(*keys, "window"), "word")
        carried = (*keys, "n_windows")
        return mean_by_word(weigh(count_per_word(dealt.rows()), vocab, keys=carried, keep_empty=True, dealt=dealt))
    weighted = weigh(windows, vocab, keys=keys, keep_empty=True)
    return mean_by_word(weighted.join(Wt.windows_per_word(windows), "word"))


def corpus_centroids(lines: DataFrame, *, wsize: int = 10, samples: int = 50, seed: int = 42,
                     stop: list[str] | None = None, vocab: DataFrame | None = None,
                     min_df: int = 1, max_df: float = 1.0, weighting: str = "tfidf") -> DataFrame:
    """Lines to word centroids in one call; the result is a written table."""
    stop = T.stop_words("english") if stop is None else stop
    given = vocab is not None
    if not given:
        vocab = cut(Wt.vocabulary(lines, stop=stop, min_df=min_df, max_df=max_df), "vocab")
    windows = P.context_windows(lines, wsize=wsize, samples=samples, seed=seed, exclude=stop)
    if given or min_df > 1 or max_df < 1.0:
        windows = P.in_vocabulary(windows, vocab)
    return cut(word_centroids(windows, vocab, weighting=weighting, by_word=samples > 0), "centroids")
