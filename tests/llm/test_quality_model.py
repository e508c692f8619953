import random
import zlib

import numpy as np
import pyarrow as pa

from vecindario.llm import quality_model as M
from vecindario.llm.textarrays import buffers


def prose(rng, n):
    return " ".join(rng.choice(["stone", "river", "and", "the", "quiet", "harbour", "light", "over", "walked"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def tables(spark, n=600):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        text = prose(rng, rng.randint(5, 120)) if good else rng.choice([" | ".join, lambda w: "!! ".join(x.upper() for x in w), lambda w: "### ".join(w)])(prose(rng, 60).split())
        docs.append((i, text, "en"))
        if i % 2:
            labels.append((i, int(good), 0))
    docs += [(n, None, "en"), (n + 1, "", None), (n + 2, "\n \t", "x"), (n + 3, "word " * 200_000, "x")]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(5),
            spark.createDataFrame(labels + [(1, None, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in labels), n + 4)


def test_held_out_accuracy_and_shape(spark):
    docs, labels, truth, n = tables(spark)
    out = M.classify(docs, labels).collect()
    assert len(out) == n
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    judged = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(judged) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in judged]) > 0.97


def test_normal_equations_do_not_depend_on_partitions(spark):
    docs, labels, _, _ = tables(spark, 200)
    stats = M.described(docs.select("doc_id", "text")).join(labels.select("doc_id", "quality"), "doc_id").withColumnRenamed("quality", "label")
    models = [M.fit(stats.repartition(p)) for p in (1, 7)]
    assert np.allclose(models[0].weights, models[1].weights, atol=1e-6)
    rows = [r for r in stats.collect() if r.label is not None]
    folds = {r.doc_id for r in stats.selectExpr("doc_id", "pmod(xxhash64('calibration', cast(doc_id as string)), 5) as f").filter("f = 0").collect()}
    z = models[0].cosines(np.array([r.stats for r in rows if r.doc_id not in folds]))
    y = np.array([r.label for r in rows if r.doc_id not in folds])
    penalty = M.RIDGE * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    assert np.allclose(z @ np.linalg.solve(z.T @ z + penalty, z.T @ y), z @ models[0].weights, atol=1e-5)


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in M.classify(docs, none).collect()} == {0.5}
    assert M.classify(docs.limit(0), none).count() == 0


def test_statistics():
    texts = ["a b a b", "", None, "X!! Y!!", "é\nword | x", "tail"]
    stats = dict(zip(M.STATISTICS, M.statistics(*buffers(pa.array(texts, pa.string()))).T))
    assert np.allclose(np.expm1(stats["log_words"]), [4, 0, 0, 2, 4, 1])
    assert np.allclose(stats["distinct_words"], [0.5, 0, 0, 1, 1, 1]) and np.allclose(stats["shout"], [0, 0, 0, 4 / 7, 0, 0])
    alone = [M.statistics(*buffers(pa.array([t], pa.string())))[0] for t in texts]
    assert np.allclose(alone, np.stack([stats[s] for s in M.STATISTICS], axis=1))


def test_pooled_is_monotone_and_best():
    v, w = np.array([1.0, 3, 2, 2, 5, 4]), np.array([1.0, 1, 1, 2, 1, 1])
    assert np.allclose(M.pooled(v, w), [1, 2.25, 2.25, 2.25, 4.5, 4.5]) and len(M.pooled(v[:0], w[:0])) == 0
