"""Corpus to word vectors in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..operators import centroids as Ce, postings as P, projections as J, weights as Wt
from ..session import cut
from ..sources.vectors import write_vectors

METHODS = ("svd", "random", "nmf", "kmeans", "minibatch", "summaries", "topics", "discriminant", "graph", "tangent")


def word_vectors(lines: DataFrame, method: str = "svd", *, dim: int = 100, samples: int = 50, wsize: int = 10,
                 seed: int = 42, stop: list[str] | None = None, vocab: DataFrame | None = None,
                 batch_size: int | None = None, n_batches: int | None = 16) -> DataFrame:
    """``(word, vec)`` for every vocabulary word that occurs in ``lines``.

    ``vocab`` may hold weights fitted elsewhere, ``(term, df, idf)``. Mini-batches run one after the other, so
    their number is fixed unless ``n_batches=None`` and a ``batch_size`` are given.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    stop = T.stop_words("english") if stop is None else stop
    if method == "topics":
        counts = Ce.corpus_centroids(lines, wsize=wsize, samples=samples, seed=seed, stop=stop, vocab=vocab,
                                     min_df=2, max_df=0.95, weighting="counts")
        return J.topic_vectors(counts, dim=dim)
    given = vocab is not None
    vocab = vocab if given else cut(Wt.vocabulary(lines, stop=stop), "vocab")
    windows = P.context_windows(lines, wsize=wsize, samples=samples, seed=seed, exclude=stop)
    if given:
        windows = P.in_vocabulary(windows, vocab)
    if method == "discriminant":
        if samples > 0:
            return J.discriminant_vectors(Wt.dealt_tfidf(windows, vocab), vocab, dim=dim, known=True)
        return J.discriminant_vectors(Wt.tfidf_windows(windows, vocab, keep_empty=True), vocab, dim=dim)
    centroids = cut(Ce.word_centroids(windows, vocab, by_word=samples > 0), "centroids")
    if method == "random":
        return J.random_vectors(centroids, vocab, dim=dim, seed=seed)
    if method == "summaries":
        return J.summary_vectors(centroids, vocab, dim=dim, seed=seed)
    if method == "minibatch":
        return J.minibatch_vectors(centroids, dim=dim, batch_size=batch_size, n_batches=n_batches)
    run = {"svd": J.svd_vectors, "nmf": J.nmf_vectors, "kmeans": J.kmeans_vectors, "graph": J.graph_vectors,
           "tangent": J.tangent_vectors}
    return run[method](centroids, dim=dim)


def write_word_vectors(lines: DataFrame, path: str, method: str = "svd", *, single_file: bool = False,
                       mode: str = "errorifexists", **options) -> None:
    """Project a corpus and write its vectors: ``word_vectors`` and ``write_vectors`` in one call."""
    write_vectors(cut(word_vectors(lines, method, **options), "vectors"), path, single_file=single_file, mode=mode)
