import os

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, PCA, HashingTF

from vecindario.operators import centroids as Ce, postings as P, windows as Wn
from vecindario.plans import catalog as Q, predict as Pr
from vecindario.sources import corpus as C, vectors as V
from vecindario.streaming import centers as SC, postings as SP

KEYS = ("doc_id", "line_no", "pos")
SF = "/root/testdata/sf0.001"


def test_vector_files(spark, tmp_path):
    vectors = spark.createDataFrame([("sol", [0.5, -1.25]), ("12", [1.0, 2.0])], "word string, vec array<double>")
    for single in (False, True):
        path = str(tmp_path / f"vec{single}")
        V.write_vectors(vectors, path, single_file=single)
        parts = sorted((tmp_path / f"vec{single}").glob("part-*"))
        text = "".join(p.read_text() for p in parts).splitlines()
        assert text == ["2 2", "12 1.000000 2.000000", "sol 0.500000 -1.250000"]
        back = {r["word"]: list(r["vec"]) for r in V.read_vectors(spark, path).collect()}
        assert back == {"sol": [0.5, -1.25], "12": [1.0, 2.0]}


def test_predictions_round_trip(spark, corpus, tmp_path):
    rows = Pr.prepare(Wn.token_windows(corpus, size=3), keys=KEYS, min_count=1)
    scored = Pr.fit_predict(rows, Pr.logistic(max_iter=5), num_features=64)
    test = rows.filter("split = 'test'").count()
    assert scored.count() == test > 0
    path = str(tmp_path / "predictions")
    V.write_predictions(scored, path)
    back = spark.read.csv(path, header=True)
    assert back.count() == test and "window" in back.columns and "pred_word" in back.columns


@pytest.mark.parametrize("kind", [None, NaiveBayes])
def test_one_vs_rest(corpus, kind):
    rows = Pr.prepare(Wn.shingle_windows(corpus), keys=KEYS, min_count=8, stratified=True)
    scored = Pr.fit_predict(rows, Pr.one_vs_rest(kind and kind()), num_features=32)
    assert scored.filter("pred_word is null").isEmpty()


def test_fit_is_bounded_and_every_test_window_scored(corpus):
    rows = Pr.prepare(Wn.token_windows(corpus, size=3), keys=KEYS)
    scored = Pr.fit_predict(rows, NaiveBayes(), num_features=32, keys=KEYS, max_fit_rows=20).collect()
    assert len(scored) == rows.filter("split = 'test'").count()
    assert any(r.label is None for r in scored)
    numbers = {r.label for r in scored if r.label is not None}
    assert max(numbers) < 20 and all(r.pred_word for r in scored)


@pytest.mark.parametrize("components", [None, 2])
def test_tree_predicts_every_test_window(corpus, components):
    rows = Pr.prepare(Wn.token_windows(corpus, size=3), keys=KEYS)
    scored = Pr.tree_predict(rows, num_features=64, components=components, rounds=4).collect()
    test = {tuple(r) for r in rows.filter("split = 'test'").select(*KEYS, "word", "label").collect()}
    assert {(*(r[k] for k in KEYS), r.word, r.label) for r in scored} == test and len(scored) == len(test)
    known = dict(rows.filter("split = 'train'").select("word", "label").distinct().collect())
    assert all(known[r.pred_word] == r.prediction for r in scored)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", ["predict_center_lr", "predict_center_pca", "predict_center_ovr"])
def test_queries_drop_no_labels(spark, monkeypatch, name):
    for plan in ("tree_predict", "class_trees_predict"):
        monkeypatch.setattr(Q.Pr, plan, lambda rows, *_, **__: rows)
    rows = Q.QUERIES[name](spark, SF)
    if name == "predict_center_ovr":
        counts = Wn.shingle_windows(Q.bench_lines(spark, SF)).groupBy("word").count().filter("count > 2")
        assert rows.select("word").distinct().join(counts, "word").count() > counts.filter("count <= 15").count() > 0
    else:
        assert rows.count() == Q.sliding_rows(spark, SF).count()


def test_pca(corpus):
    windows = Wn.token_windows(corpus, size=3)
    out = Pr.pca_windows(windows, k=2, num_features=32)
    assert out.count() == windows.count() and len(out.first()["pca"]) == 2


def test_pca_equals_ml_and_reads_the_windows_once(spark, corpus):
    windows = Wn.token_windows(corpus, size=5)
    stages = [HashingTF(inputCol="window", outputCol="tf", numFeatures=32), IDF(inputCol="tf", outputCol="weighted"),
              PCA(k=2, inputCol="weighted", outputCol="pca")]
    key = lambda r: (r.doc_id, r.line_no, r.pos)
    want = {key(r): np.abs(r.pca.toArray()) for r in Pipeline(stages=stages).fit(windows).transform(windows).collect()}
    spark.sparkContext.setJobGroup("pca", "pca")
    out = Pr.pca_windows(windows, k=2, num_features=32)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("pca")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 3
    got = out.collect()
    assert len(got) == len(want) and out.columns == [*windows.columns, "pca"]
    assert all(np.allclose(np.abs(r.pca.toArray()), want[key(r)], atol=1e-9) for r in got)


def test_stream_postings_equal_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"sol luna {i}0\nmar sol") for i in range(30)], "doc_id long, text string")
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    docs.repartition(5).write.parquet(source)
    for _ in range(2):
        query = SP.stream_postings(spark, source, docs.schema, out, check, files_per_trigger=2)
        query.awaitTermination()
    more = spark.createDataFrame([(99, "nube")], docs.schema)
    more.write.mode("append").parquet(source)
    SP.stream_postings(spark, source, docs.schema, out, check).awaitTermination()
    want = P.postings(C.lines_from_column(docs.unionByName(more)))
    got = SP.read_postings(spark, out)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("files, merge_every", [(1, 16), (5, 2)])
def test_stream_samples_equal_batch(spark, tmp_path, files, merge_every):
    docs = spark.createDataFrame(
        [(i, f"sol sol luna {i}\nmar sol") for i in range(30)] + [(50, None), (51, "")], "doc_id long, text string")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.repartition(files).write.parquet(source)
    want = sorted(map(tuple, P.sample(P.postings(C.lines_from_column(docs)), 7).collect()))
    for check in ("first", "replay"):
        query = SP.stream_sampled_postings(spark, source, docs.schema, out, str(tmp_path / check), samples=7,
                                           merge_every=merge_every, files_per_trigger=1)
        query.awaitTermination()
        last = query.lastProgress["batchId"]
        got = SP.read_sampled_postings(spark, out, last, samples=7, merge_every=merge_every)
        assert sorted(map(tuple, got.collect())) == want
    assert sum(r[0] == "sol" for r in want) == 7


def test_stream_centers_survive_a_replay(spark, corpus, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    packed = SC.pack(Ce.corpus_centroids(corpus, stop=[]))
    packed.repartition(3, "word").write.parquet(source)
    words = packed.count()

    def run(check):
        query = SC.stream_centers(spark, source, state, str(tmp_path / check), 2, files_per_trigger=1)
        query.awaitTermination()
        last = query.lastProgress["batchId"]
        centers, seen = SC.read_centers(spark, state, last)
        return last, {r["term"]: np.array(list(r)[1:]) for r in centers.collect()}, seen

    last, first, seen = run("check1")
    assert last == 2 and seen.sum() == words
    _, again, _ = run("check2")
    assert first.keys() == again.keys() and all(np.allclose(first[t], again[t]) for t in first)


def test_stream_postings_of_a_folder(spark, tmp_path):
    from vecindario.plans.catalog import QUERIES
    docs = spark.createDataFrame([(i, f"sol luna{i}\nmar") for i in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.toPandas().to_parquet(_made(tmp_path / "one") / "documents.parquet")
    want = sorted(tuple(r) for r in QUERIES["postings"](spark, str(tmp_path / "one")).collect())
    for name in ("many", "one"):
        assert sorted(tuple(r) for r in QUERIES["stream_postings"](spark, str(tmp_path / name)).collect()) == want


def _made(path):
    path.mkdir()
    return path


def test_sampled_stream_query_deals_each_batch_to_all_cores(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"sol luna {i}0\nmar sol") for i in range(400)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    run, batches = SP.stream_sampled_postings, []

    def spied(session, source, *args, **options):
        batches.append((len([f for f in os.listdir(source[source.index("/"):]) if f.endswith(".parquet")]), options["files_per_trigger"]))
        return run(session, source, *args, **options)

    monkeypatch.setattr(Q.SP, "stream_sampled_postings", spied)
    out = Q.stream_sampled_postings(spark, str(tmp_path)).collect()
    (files, of_a_batch), = batches
    assert of_a_batch >= spark.sparkContext.defaultParallelism and 3 * of_a_batch < files <= 4 * of_a_batch
    lines = C.lines_from_column(docs)
    assert sorted(out) == sorted(P.sample(P.postings(lines)).collect())
