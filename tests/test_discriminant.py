import numpy as np
import pytest

from vecindario.operators import postings as P, weights as Wt
from vecindario.operators.projections import discriminant as D
from vecindario.session import cut


def vectors_of(df):
    return {r["word"]: np.array(r["vec"]) for r in df.collect()}


def test_windows_are_summed_where_they_are_dealt(corpus, monkeypatch):
    vocab = cut(Wt.vocabulary(corpus, stop=[]))
    windows = P.context_windows(corpus)
    want = vectors_of(D.discriminant_vectors(Wt.tfidf_windows(windows, vocab, keep_empty=True), vocab, dim=3, reduced=12))
    written, plain, weights = [], D.cut, Wt.dealt_tfidf(windows, vocab)
    monkeypatch.setattr(D, "cut", lambda df, name: written.append((name, df)) or plain(df, name))
    got = vectors_of(D.discriminant_vectors(weights, vocab, dim=3, reduced=12, known=True))
    assert got.keys() == want.keys() and all(np.allclose(got[w], want[w]) for w in want)
    assert [name for name, _ in written] == ["sums"]  # neither the weights nor the windows' rows
    plan = written[0][1]._jdf.queryExecution().explainString(written[0][1].sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.count("Exchange hashpartitioning") == 2  # the windows by word, and the sums


@pytest.mark.parametrize("reduced", [5, 40])
def test_sums_equal_numpy(spark, reduced):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, reduced))
    words = [None if i % 7 == 0 else f"w{i % 7}" for i in range(50)]
    rows = spark.createDataFrame([(w, *map(float, v)) for w, v in zip(words, x)], ["word", *[f"c{j}" for j in range(reduced)]]).repartition(3)
    found = D._sums(rows).collect()
    gram = np.array([list(r)[4:] for r in sorted((r for r in found if r["kind"] == 1), key=lambda r: r["i"])])
    assert np.allclose(gram, x.T @ x)
    for r in found:
        if r["kind"] == 0:
            own = [w == r["word"] for w in words]
            assert r["n"] == sum(own) and np.allclose(list(r)[4:], x[own].sum(axis=0))
