import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vecindario.operators import centroids as Ce, labels as Lb, postings as P, weights as Wt
from vecindario.session import cut


def brute_centroids(rows, stop, wsize):
    """Plain Python: sublinear TF-IDF of every window, unit length, mean per word."""
    toks = [r["line"].split() for r in rows]
    df = Counter(t for line in toks for t in set(line))
    idf = {t: math.log((1 + len(toks)) / (1 + n)) + 1 for t, n in df.items() if t not in stop}
    sums, n = defaultdict(Counter), Counter()
    for line in toks:
        for i, word in enumerate(line):
            if word in stop:
                continue
            tf = Counter(t for t in line[max(0, i - wsize):i] + line[i + 1:i + 1 + wsize] if t in idf)
            raw = {t: (1 + math.log(c)) * idf[t] for t, c in tf.items()}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            n[word] += 1
            for t, v in raw.items():
                sums[word][t] += v / norm
    return {(w, t): v / n[w] for w in sums for t, v in sums[w].items()}, n


@pytest.mark.parametrize("samples", [0, 1000])
def test_centroids_match_brute_force(corpus, samples):
    stop = ["sol"]
    X = Ce.corpus_centroids(corpus, wsize=3, samples=samples, stop=stop)
    got = {(r["word"], r["term"]): r["weight"] for r in X.collect() if r["term"] is not None}
    want, n = brute_centroids(corpus.collect(), stop, 3)
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12
    assert {r["word"]: r["n_windows"] for r in X.collect()} == dict(n)


def test_word_without_known_context_keeps_a_row(lines):
    X = Ce.corpus_centroids(lines("solo", "mar azul"), stop=[])
    row = X.filter("word = 'solo'").collect()
    assert [(r["term"], r["weight"], r["n_windows"]) for r in row] == [(None, 0.0, 1)]


def test_windows_without_terms_count_in_the_mean(lines):
    X = Ce.corpus_centroids(lines("solo", "solo mar"), stop=[])
    assert X.filter("word = 'solo'").first()["weight"] == pytest.approx(0.5)


def test_centroids_do_not_depend_on_partitions(corpus):
    def run(n):
        X = Ce.corpus_centroids(corpus.repartition(n), samples=4, stop=[])
        return {(r["word"], r["term"]): round(r["weight"], 9) for r in X.collect()}
    assert run(1) == run(4) == run(32)


def test_one_shuffle_by_word_serves_norm_and_mean(corpus):
    vocab, windows = cut(Wt.vocabulary(corpus)), cut(P.context_windows(corpus))
    plan = Ce.word_centroids(windows, vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_rare_terms_travel_to_the_vocabulary(spark, corpus, monkeypatch):
    vocab = cut(Wt.vocabulary(corpus, stop=["dos", "uno"]))
    windows = cut(P.context_windows(corpus, samples=0))
    windows = cut(windows.unionByName(windows.limit(3)).unionByName(windows.limit(3).withColumn("doc_id", F.lit(None).cast("bigint"))))

    def rows(df):
        return sorted(map(str, df.withColumns({c: F.round(c, 9) for c in df.columns if c == "weight"}).collect()))

    def every():
        return [rows(f(windows, vocab, keep_empty=e)) for f in (Wt.tfidf_windows, Wt.count_windows) for e in (False, True)] + [
            rows(Ce.word_centroids(windows, vocab, weighting=w)) for w in ("tfidf", "counts")]

    whole = every()
    monkeypatch.setattr(Wt, "HEAD_TERMS", 3)
    assert every() == whole
    monkeypatch.setattr(Wt, "parts_for", lambda df: 7)
    plan = Ce.word_centroids(windows, vocab)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(word") == 2 and "Union" in plan  # the windows, once for each side; the union stays dealt
    assert every() == whole


def test_pruning_and_external_weights(corpus):
    vocab = Wt.vocabulary(corpus, min_df=2, max_df=0.5)
    rows = {r["term"]: r["df"] for r in vocab.collect()}
    assert rows and all(2 <= n <= 20 for n in rows.values())
    X = Ce.corpus_centroids(corpus, stop=[], vocab=cut(vocab))
    assert {r[0] for r in X.select("word").distinct().collect()} == set(rows)


def test_unknown_weighting(corpus):
    with pytest.raises(ValueError):
        Ce.word_centroids(corpus, corpus, weighting="none")


def label_rows(spark, counts):
    rows = [(w, f"{w}{i}") for w, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "word string, key string")


def test_inverse_rank_weights(spark):
    rows = label_rows(spark, {"a": 5, "b": 3, "c": 3, "d": 1})
    got = Lb.inverse_rank_weights(Lb.frequent(Lb.label_counts(rows), 0)).orderBy("id").collect()
    assert [(r["word"], r["count"], r["ascc"]) for r in got] == [("a", 5, 1), ("b", 3, 3), ("c", 3, 3), ("d", 1, 5)]
    assert got[0]["weight_n"] == pytest.approx(0.01 / (4 / 12)) and got[3]["weight_n"] == 1.0


def test_equal_counts_keep_everything(spark):
    rows = label_rows(spark, {"a": 4, "b": 4})
    weights = Lb.inverse_rank_weights(Lb.label_counts(rows))
    assert {r["weight_n"] for r in weights.collect()} == {1.0}
    assert Lb.stratified_sample(rows, weights, ("key",)).count() == 8


def test_rare_labels(spark):
    rows = label_rows(spark, {"a": 6, "b": 3, "c": 1})
    assert {r[0] for r in Lb.drop_rare(rows, min_count=2).select("word").distinct().collect()} == {"a", "b"}


def test_few_labels_are_broadcast(spark, monkeypatch):
    counts = {"a": 9, "b": 7, "c": 4, "d": 3, "e": 2, "f": 1}
    rows = cut(label_rows(spark, counts).union(label_rows(spark, {"x": 4}).withColumn("word", F.lit(None).cast("string"))))
    weights = cut(Lb.inverse_rank_weights(Lb.label_counts(rows.filter("word is not null"))))

    def every():
        found = (Lb.drop_rare(rows, min_count=2), Lb.stratified_sample(rows, weights, ("key",)), Lb.join_labels(rows, weights, "word", F.col("id")))
        assert "Exchange hashpartitioning" not in found[0]._jdf.queryExecution().executedPlan().toString() or Lb.HEAD_LABELS == 2
        return [sorted(map(str, df.collect())) for df in found]

    whole = every()
    assert len(whole[0]) == 27 and len(whole[2]) == 26
    monkeypatch.setattr(Lb, "HEAD_LABELS", 2)
    assert every() == whole


def test_label_index_and_decode(spark):
    rows = label_rows(spark, {"b": 2, "a": 2, "c": 5})
    index = Lb.label_index(rows)
    assert {r["word"]: r["label"] for r in index.collect()} == {"c": 0.0, "a": 1.0, "b": 2.0}
    scored = spark.createDataFrame([(0.0,), (9.0,)], "prediction double")
    assert sorted(r["pred_word"] for r in Lb.decode_labels(scored, index).collect()) == ["", "c"]
    small = Lb.to_map(index.select("label", "word"), "label", "word").first()[0]
    assert small[1.0] == "a"


def test_split_is_complete_and_stable(spark):
    rows = label_rows(spark, {"a": 500})
    first = {r["key"]: r["split"] for r in Lb.hash_split(rows, ("key",)).collect()}
    again = {r["key"]: r["split"] for r in Lb.hash_split(rows.repartition(9), ("key",)).collect()}
    assert first == again and len(first) == 500
    assert 0.6 < sum(v == "train" for v in first.values()) / 500 < 0.8
