import random
from collections import defaultdict

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import functions as F

from vecindario.operators import class_trees as CT
from vecindario.plans import predict as Pr
from vecindario.session import cut

WIDTH = 10


def made(n=160, seed=5):
    """Rows of (id, word, {bucket: value}): words prefer some buckets, values repeat."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        word = f"w{min(int(rng.expovariate(0.5)), 5)}"
        at = {(int(word[1]) * 3 + j) % WIDTH if rng.random() < 0.6 else rng.randrange(WIDTH): float(rng.randint(1, 3)) for j in range(rng.randint(0, 4))}
        rows.append((i, word, at))
    return rows


def frame(spark, rows):
    data = [(i, w, None if f is None else list(f.items())) for i, w, f in rows]
    return spark.createDataFrame(data, f"id int, word string, features {CT.FEATURES}").repartition(3)


def walked(model, rows):
    """{id: {word: (n, p)}} by trying every leaf on every row."""
    edges = {r.bucket: r.edges for r in model.edges.collect()}
    leaves = model.leaves.collect()
    out = defaultdict(dict)
    for i, _, features in rows:
        bins = {b: sum(e < v for e in edges.get(b, [])) for b, v in (features or {}).items()}
        for leaf in leaves:
            if all((bins.get(c["bucket"], 0) > c["bin"]) == c["above"] for c in leaf.path):
                assert leaf.word not in out[i]  # one leaf of a tree
                out[i][leaf.word] = (leaf.n, leaf.p)
    return out


def test_leaves_hold_the_rows_that_reach_them(spark):
    rows = made()
    model = CT.fit(frame(spark, rows))
    reached = walked(model, rows)
    sizes, words = defaultdict(set), {w for _, w, _ in rows}
    counts = defaultdict(lambda: [0, 0])
    edges = {r.bucket: r.edges for r in model.edges.collect()}
    for leaf in model.leaves.collect():
        key = (leaf.word, tuple(map(tuple, leaf.path)))
        for _, word, features in rows:
            bins = {b: sum(e < v for e in edges[b]) for b, v in features.items()}
            if all((bins.get(c["bucket"], 0) > c["bin"]) == c["above"] for c in leaf.path):
                counts[key][0] += 1
                counts[key][1] += word == leaf.word
        sizes[leaf.word].add(len(leaf.path))
        assert counts[key] == [leaf.n, leaf.p]
    assert all(set(per) == words for per in reached.values())
    assert max(max(s) for s in sizes.values()) <= CT.MAX_DEPTH


def test_each_class_equals_the_single_tree(spark):
    rows = made()
    train, asked = [r for r in rows if r[0] % 4], rows
    reached = walked(CT.fit(frame(spark, train)), asked)

    def vectors(part, word):
        data = [(i, float(w == word), SparseVector(WIDTH, sorted(f.items()))) for i, w, f in part]
        schema = spark.createDataFrame([], "id int, label double").schema.add("features", VectorUDT())
        return spark.createDataFrame(data, schema)
    for word in sorted({w for _, w, _ in train}):
        single = DecisionTreeClassifier().fit(vectors(train, word))
        for r in single.transform(vectors(asked, word)).collect():
            n, p = reached[r.id][word]
            assert (2 * p > n) == (r.prediction == 1.0), (word, r.id)


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_prediction_equals_all_trees_walked(spark, depth):
    rows = made()
    rows += [(900, "w0", None), (901, None, {1: 2.0}), (902, "never", {3: 1.0, 99: 4.0}), (903, "w1", {3: 9.0}), (904, "w1", {3: 9.0})]
    train, asked = [r for r in rows if r[0] % 3 and r[1] != "never"], rows
    model = CT.fit(frame(spark, train), max_depth=depth)
    reached = walked(model, asked)
    got = {r.id: r for r in CT.predict(frame(spark, asked), model).collect()}
    assert set(got) == {r[0] for r in asked}
    for i, row in got.items():
        minus, _, word = min((-(p / n), -p, w) for w, (n, p) in reached[i].items())
        assert (row.pred_word, row.share) == (word, pytest.approx(-minus))


def test_many_values_share_bins_and_partitions_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(i, f"w{i % 3}", {0: rng.random() + (i % 3) * 0.5, 1: float(rng.randint(0, 2))}) for i in range(200)]
    one, other = (CT.fit(frame(spark, rows).repartition(n), max_bins=8) for n in (1, 6))
    assert all(len(r.edges) <= 8 for r in one.edges.collect())
    held = [sorted((r.word, tuple(map(tuple, r.path)), r.n, r.p) for r in m.leaves.collect()) for m in (one, other)]
    assert held[0] == held[1] and len(held[0]) > 6


def test_listed_twice_no_class_and_no_rows(spark):
    twice = spark.createDataFrame([(0, "a", [(1, 1.0), (1, 2.0)]), (1, "b", [(1, 1.0)])], f"id int, word string, features {CT.FEATURES}")
    assert {r.id: r.pred_word for r in CT.predict(twice, CT.fit(twice)).collect()} == {0: "a", 1: "b"}
    nobody = CT.fit(twice.withColumn("word", F.lit(None).cast("string")))
    assert {(r.pred_word, r.share) for r in CT.predict(twice, nobody).collect()} == {(None, None)}
    assert CT.predict(twice.limit(0), CT.fit(twice)).collect() == []
    clash = twice.withColumn("pred_word", F.lit("x")).withColumn("cells", F.lit(1)).withColumn("_bag", F.lit(2)).withColumn("rank", F.lit(3))
    out = CT.predict(clash, CT.fit(twice))
    assert out.columns == ["id", "word", "features", "cells", "_bag", "rank", "pred_word", "share"] and {r.rank for r in out.collect()} == {3}


def test_plan_fits_all_windows(corpus):
    from vecindario.operators import windows as Wn
    keys = ("doc_id", "line_no", "pos")
    rows = Pr.prepare(Wn.token_windows(corpus, size=3), keys=keys)
    out = cut(Pr.class_trees_predict(rows, num_features=32))
    assert out.count() == rows.filter("split = 'test'").count()
    assert out.filter("pred_word is null").isEmpty() and "split" not in out.columns
