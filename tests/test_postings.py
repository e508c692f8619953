import pytest
from pyspark.sql import functions as F

from vecindario.operators import postings as P, ranks as R, windows as Wn
from vecindario.sources import corpus as C, index as I


def contexts(df):
    return {(r["word"], r["line_no"], r["offset"]): list(r["window"]) for r in df.collect()}


@pytest.mark.parametrize("samples", [0, 50])
def test_context_edges(lines, samples):
    df = lines("a1 b2 c3 d4 e5", "sol luna sol", "hola", "")
    got = contexts(P.context_windows(df, wsize=2, samples=samples))
    assert got[("a1", 0, 0)] == ["b2", "c3"]
    assert got[("c3", 0, 2)] == ["a1", "b2", "d4", "e5"]
    assert got[("e5", 0, 4)] == ["c3", "d4"]
    assert got[("sol", 1, 0)] == ["luna", "sol"] and got[("sol", 1, 2)] == ["sol", "luna"]
    assert got[("hola", 2, 0)] == []
    assert len(got) == 9


@pytest.mark.parametrize("n, kept", [(0, 3), (-1, 3), (2, 2), (50, 3)])
def test_sample_sizes(lines, n, kept):
    posts = P.postings(lines("sol luna", "sol", "mar sol"))
    assert P.sample(posts, n).filter("word = 'sol'").count() == kept


def test_sample_is_subset_and_independent_of_partitions(corpus):
    posts = P.postings(corpus)
    one = {tuple(r) for r in P.sample(posts.repartition(1), 3).collect()}
    many = {tuple(r) for r in P.sample(posts.repartition(32), 3).collect()}
    assert one == many <= {tuple(r) for r in posts.collect()}
    assert one != {tuple(r) for r in P.sample(posts, 3, seed=7).collect()}


def test_hot_word_is_limited_before_the_shuffle(corpus):
    plan = P.sample(P.postings(corpus), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_words_and_exclude(corpus):
    only = P.context_windows(corpus, words=["sol"], samples=0)
    assert {r[0] for r in only.select("word").distinct().collect()} == {"sol"}
    rest = P.context_windows(corpus, exclude=["sol"])
    assert rest.filter("word = 'sol'").isEmpty()
    assert not rest.filter(F.array_contains("window", "sol")).isEmpty()


def test_coordinate_codec(spark):
    df = spark.createDataFrame([(12, 7)], "line_no int, offset int")
    coded = df.select(P.encode_coordinate(F.col("line_no"), F.col("offset")).alias("coo"))
    assert coded.first()[0] == "12,7"
    assert tuple(coded.select(P.decode_coordinate(F.col("coo"))).first()[0]) == (12, 7)


def test_missing_words(spark, lines):
    vocab = spark.createDataFrame([("sol",), ("nube",)], "term string")
    assert [r[0] for r in P.missing_words(vocab, P.postings(lines("sol y mar"))).collect()] == ["nube"]


def test_token_windows(lines):
    df = lines("uno dos", "a1 b2 c3 d4", "")
    got = [(r["line_no"], r["pos"], r["word"], list(r["window"])) for r in Wn.token_windows(df, size=3).orderBy("pos").collect()]
    assert got == [(1, 0, "b2", ["a1", "c3"]), (1, 1, "c3", ["b2", "d4"])]
    assert Wn.token_windows(df, size=4).isEmpty()
    kept = Wn.token_windows(df, size=3, exclude_center=False).first()
    assert kept["word"] in kept["window"]


def test_shingle_windows(lines):
    got = Wn.shingle_windows(lines("abc", "", "uvwxyzuvw")).collect()
    short = [r for r in got if r["line_no"] == 0]
    assert [(r["word"], list(r["window"])) for r in short] == [("abc", [])]
    full = [r for r in got if r["line_no"] == 2]
    assert len(full) == 1 and full[0]["word"] == "xyz" and len(full[0]["window"]) == 6


def test_dense_index_and_batches(spark):
    df = spark.range(0, 1000, numPartitions=7).select(F.md5(F.col("id").cast("string")).alias("word"))
    got = [r["id"] for r in R.dense_index(df, F.col("word")).orderBy("word").collect()]
    assert got == list(range(1000))
    sizes = {r["count"] for r in R.batches(df, 100).groupBy("batch_id").count().collect()}
    assert sizes == {100}


def test_read_lines_numbers_across_blocks(spark, tmp_path):
    texts = [f"línea {i} " + "x" * (i % 40) for i in range(400)]
    for name, part in (("a.txt", texts), ("b.txt", texts[:57])):
        (tmp_path / name).write_bytes("\r\n".join(part).encode() + b"\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = C.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], {})[r["line_no"]] = r["line"]
    assert sorted(len(d) for d in by_doc.values()) == [57, 400]
    for doc in by_doc.values():
        assert [doc[i] for i in range(len(doc))] == [t.strip() for t in texts[:len(doc)]]


def test_decode_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"a\xff\nb")
    assert C.decode_files(spark, str(tmp_path)).first()["text"] == "a�\nb"


def test_index_is_reused(spark, corpus, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return P.postings(corpus)

    path = str(tmp_path / "index")
    first = I.open_or_build(spark, path, build, tokenizer="words")
    again = I.open_or_build(spark, path, build, tokenizer="words")
    assert len(calls) == 1 and first.count() == again.count() == P.postings(corpus).count()
    plan = P.lookup(again, ["sol"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(word, [sol])" in plan or "EqualTo(word,sol)" in plan
    with pytest.raises(ValueError):
        I.open_or_build(spark, path, build, tokenizer="blanks")


def test_index_refuses_another_corpus(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    I.open_or_build(spark, path, lambda: P.postings(corpus), corpus=corpus)
    assert I.open_or_build(spark, path, None, corpus=corpus.repartition(5)).count() > 0
    with pytest.raises(ValueError):
        I.open_or_build(spark, path, None, corpus=corpus.filter("line_no <> 1"))
    assert I.fingerprint(corpus.limit(0)) == "0:0"


def test_cutoffs_keep_the_lowest_hashes(spark):
    rows = [("sol", i // 50, i % 50, 0) for i in range(3000)] + [("luna", i, 0, 1) for i in range(30)] + [(None, i, 0, 2) for i in range(90)]
    rows += [("mar", 1, 1, 1)] * 400 + [("sol", 0, 0, 0)] * 3
    posts = spark.createDataFrame(rows, "word string, doc_id long, line_no int, offset int")
    ranked = posts.withColumn("rank_key", P.hash_key("word", "doc_id", "line_no", "offset"))
    cutoffs = {r["word"]: r["cutoff"] for r in P.hash_cutoffs(ranked, 10).collect()}
    assert "sol" in cutoffs and "luna" not in cutoffs and None not in cutoffs
    below = sorted(r["rank_key"] for r in ranked.filter("word = 'sol'").collect() if r["rank_key"] < cutoffs["sol"])
    assert 10 <= len(below) < 300
    keyed = {}
    for r in ranked.collect():
        keyed.setdefault(r["word"], []).append((r["rank_key"], r["doc_id"], r["line_no"], r["offset"]))
    got = {}
    for r in P.sample(posts, 10).collect():
        got.setdefault(r["word"], []).append((r["doc_id"], r["line_no"], r["offset"]))
    assert {w: sorted(g) for w, g in got.items()} == {w: sorted(k[1:] for k in sorted(v)[:10]) for w, v in keyed.items()}
    assert len(P.hash_cutoffs(ranked, 10, most=1).collect()) == 1
