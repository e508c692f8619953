"""Named queries over the supplied tables; each runs over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import (algebra as L, centroids as Ce, distances as D, knn as K, labels as Lb, postings as P,
                         projections as J, ranks as R, weights as Wt, windows as Wn)
from ..session import cut, parts_for, scratch_path, spread
from ..sources import corpus as C, index as I, vectors as V
from ..streaming import centers as SC, postings as SP
from . import predict as Pr

LANGUAGES = {"en": "english", "es": "spanish", "fr": "french", "de": "german"}
LOOKUP_WORDS = ["the", "und", "les", "que"]
PRUNE = dict(min_df=2, max_df=0.95)
SHAPES = ("doc_id", "line_no", "pos")
VEC_DIM, EMB_DIM = 8, 16
MIN_COUNT = 2  # words or shingles seen this often or less are no classes of predict_center_nb and predict_center_ovr

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return C.lines_from_column(table(spark, sf, "documents"))


def conv_lines(spark: SparkSession, sf: str) -> DataFrame:
    talks = table(spark, sf, "conversations")
    key = (F.col("conv_id") * 1000000 + F.col("turn")).alias("doc_id")
    return C.lines_from_column(talks.select(key, "text"))


def bench_lines(spark: SparkSession, sf: str) -> DataFrame:
    return C.lines_from_column(table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id"))


def joined(df: DataFrame, column: str = "window") -> DataFrame:
    return df.withColumn(column, F.array_join(column, " "))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def widened(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.select("word", *[(F.round(F.col("vec")[j], 6) + F.lit(0.0)).alias(f"v{j}") for j in range(dim)])


# sources and text

def corpus_lines(spark, sf):
    return doc_lines(spark, sf)


def stack_corpora(spark, sf):
    docs = doc_lines(spark, sf).select(F.lit("documents").alias("corpus"), "*")
    return C.stack(docs, conv_lines(spark, sf).select(F.lit("conversations").alias("corpus"), "*"))


def clean_text(spark, sf):
    return doc_lines(spark, sf).select("doc_id", "line_no", T.clean_text(F.col("line")).alias("clean"))


def clean_text_short(spark, sf):
    return doc_lines(spark, sf).select("doc_id", "line_no", T.clean_text_short(F.col("line")).alias("clean"))


def tokens(spark, sf):
    return P.tokens(doc_lines(spark, sf))


def tokens_ws(spark, sf):
    return P.tokens(doc_lines(spark, sf), tokenizer=T.tokenize_ws)


def tokens_nostop(spark, sf):
    lines = C.lines_from_column(table(spark, sf, "documents"), keys=("doc_id", "lang"))
    words, kept = T.tokenize(F.col("line")), F.lit(None)
    for code, language in LANGUAGES.items():
        kept = F.when(F.col("lang") == code, T.remove_stop_words(words, T.stop_words(language))).otherwise(kept)
    return lines.select("doc_id", "line_no", F.posexplode(F.coalesce(kept, words)).alias("offset", "word"))


def char_ngrams(spark, sf):
    grams = T.char_ngrams(F.col("line"), 3)
    return conv_lines(spark, sf).select(
        "doc_id", "line_no", F.size(grams).alias("n_grams"), F.array_join(grams, "|").alias("grams"))


# postings and windows

def postings(spark, sf):
    return P.postings(doc_lines(spark, sf))


def postings_lookup(spark, sf):
    path = scratch_path(spark, "index")
    lines = doc_lines(spark, sf)
    index = I.open_or_build(spark, path, lambda: P.postings(lines), tokenizer="words", source="documents")
    return P.lookup(index, LOOKUP_WORDS)


def postings_to_lines(spark, sf):
    lines = conv_lines(spark, sf)
    return P.attach_lines(P.postings(lines), lines).select(
        "word", "doc_id", "line_no", "offset", F.md5("line").alias("line_md5"))


def coo_codec(spark, sf):
    posts = P.postings(doc_lines(spark, sf))
    coded = posts.select("word", "doc_id", P.encode_coordinate(F.col("line_no"), F.col("offset")).alias("coo"))
    return coded.withColumn("t", P.decode_coordinate(F.col("coo"))).select(
        "word", "doc_id", "coo", "t.line_no", "t.offset")


def sampled_postings(spark, sf):
    return P.sample(P.postings(doc_lines(spark, sf)))


def context_windows(spark, sf):
    return joined(P.context_windows(doc_lines(spark, sf)))


def kwic_words(spark, sf):
    return joined(P.context_windows(doc_lines(spark, sf), words=LOOKUP_WORDS, samples=0))


def sliding_rows(spark, sf):
    return Wn.token_windows(doc_lines(spark, sf))


def sliding_windows(spark, sf):
    return joined(sliding_rows(spark, sf))


def sliding_windows_stop(spark, sf):
    return joined(Wn.token_windows(doc_lines(spark, sf), stop=T.stop_words()))


def sliding_windows_ascii(spark, sf):
    return joined(Wn.token_windows(doc_lines(spark, sf), ascii_only=True))


def sliding_windows_whole(spark, sf):
    return joined(Wn.token_windows(doc_lines(spark, sf), exclude_center=False))


def context_windows_all(spark, sf):
    return joined(P.context_windows(conv_lines(spark, sf), samples=0))


def shingle_windows(spark, sf):
    rows = Wn.shingle_windows(conv_lines(spark, sf))
    return rows.withColumn("window", F.array_join("window", "|"))


def batch_ids(spark, sf):
    return R.batches(P.postings(doc_lines(spark, sf)).select("word").distinct(), 100)


# vocabulary and weights

def doc_vocab(spark, sf, **prune):
    return Wt.vocabulary(doc_lines(spark, sf), stop=T.stop_words(), **prune)


def conv_windows(spark, sf):
    return P.context_windows(conv_lines(spark, sf), exclude=T.stop_words())


def conv_vocab(spark, sf):
    return cut(Wt.vocabulary(conv_lines(spark, sf), stop=T.stop_words()), "vocab")


def vocab_size(spark, sf):
    return Wt.vocab_size(doc_lines(spark, sf))


def doc_freq(spark, sf):
    return Wt.doc_freq(doc_lines(spark, sf))


def vocab_pruned(spark, sf):
    return rounded(doc_vocab(spark, sf, **PRUNE), "idf")


def vocab_postings(spark, sf):
    return P.in_vocabulary(P.postings(doc_lines(spark, sf)), doc_vocab(spark, sf, **PRUNE))


def missing_words(spark, sf):
    vocab = Wt.vocabulary(conv_lines(spark, sf), stop=T.stop_words())
    return P.missing_words(vocab, P.postings(doc_lines(spark, sf)))


def windows_per_word(spark, sf):
    return Wt.windows_per_word(P.sample(P.postings(doc_lines(spark, sf))))


def tfidf_windows(spark, sf):
    return rounded(Wt.tfidf_windows(conv_windows(spark, sf), conv_vocab(spark, sf)), "weight")


def tfidf_external_idf(spark, sf):
    path = scratch_path(spark, "weights")
    V.write_weights(doc_vocab(spark, sf), path)
    vocab = V.read_weights(spark, path)
    windows = P.in_vocabulary(conv_windows(spark, sf), vocab)
    return rounded(Wt.tfidf_windows(windows, vocab), "weight")


def count_windows(spark, sf):
    vocab = cut(Wt.vocabulary(conv_lines(spark, sf), stop=T.stop_words(), **PRUNE), "vocab")
    windows = P.in_vocabulary(conv_windows(spark, sf), vocab)
    return Wt.count_windows(windows, vocab)


def window_vectors(spark, sf):
    weights = Wt.tfidf_windows(conv_windows(spark, sf), conv_vocab(spark, sf))
    words = P.postings(conv_lines(spark, sf)).select("word").distinct().filter(~F.col("word").isin(T.stop_words()))
    labels = R.dense_index(words, F.length("word"), F.col("word"), name="label")
    return rounded(weights.join(labels, "word").drop("tf"), "weight")


def doc_centroids(spark, sf):
    return Ce.corpus_centroids(doc_lines(spark, sf))


def word_centroids(spark, sf):
    return rounded(Ce.corpus_centroids(conv_lines(spark, sf)), "weight")


def hashing_tf(spark, sf):
    rows = Wn.token_windows(conv_lines(spark, sf))
    return Wt.hashed_terms(rows, keys=SHAPES)


def plain_idf(spark, sf):
    rows = sliding_rows(spark, sf)
    lines = doc_lines(spark, sf)
    parts = parts_for(table(spark, sf, "documents").select("doc_id"), 1_024)  # a line travels once, not each of its windows
    dealt = Wn.token_windows(lines.repartition(parts, "doc_id"))
    return rounded(Wt.plain_idf(Wt.hashed_terms(dealt, keys=SHAPES, dealt=True), rows), "idf")


def sparse_matmul(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    parts = parts_for(docs, 8_192)  # lines are dealt by document once, so counts, languages and sums stay in their task
    words = P.postings(doc_lines(spark, sf).repartition(parts, "doc_id"))
    counts = words.groupBy("doc_id", "word").agg(F.count("*").cast("double").alias("weight"))
    langs = docs.repartition(parts, "doc_id").groupBy("doc_id").agg(F.collect_list(F.struct("lang")).alias("langs"))
    counts = cut(counts.join(langs, "doc_id", "left"), "counts")
    cells = counts.select(F.col("doc_id").alias("row"), "word", "weight")
    by_lang = counts.select("word", F.explode("langs").alias("l")).groupBy("word", F.col("l.lang").alias("col")).agg(
        F.count("*").cast("double").alias("weight"))
    product = L.matmul_long(cells, by_lang, on="word")
    return product.select(F.col("row").alias("doc_id"), F.col("col").alias("lang"), "weight")


# labels

def label_counts(spark, sf):
    return Lb.label_counts(sliding_rows(spark, sf))


def rare_labels(spark, sf):
    return Lb.rare(Lb.label_counts(sliding_rows(spark, sf)), 2)


def drop_rare(spark, sf):
    return joined(Lb.drop_rare(sliding_rows(spark, sf), min_count=2))


def label_index(spark, sf):
    return Lb.label_index(sliding_rows(spark, sf))


def labelled_rows(spark, sf):
    rows = sliding_rows(spark, sf).select(*SHAPES, "word")
    return rows.join(Lb.label_index(rows).select("word", "label"), "word")


def label_words(spark, sf):
    return Lb.label_words(labelled_rows(spark, sf))


def label_lookup(spark, sf):
    known = Lb.frequent(Lb.label_index(sliding_rows(spark, sf)), 2)
    rows = labelled_rows(spark, sf).select(*SHAPES, F.col("label").alias("prediction"))
    return Lb.decode_labels(rows, known)


def inverse_rank_weights(spark, sf):
    counts = Lb.frequent(Lb.label_counts(sliding_rows(spark, sf)), 2)
    return rounded(Lb.inverse_rank_weights(counts), "weight", "weight_n", digits=9)


def stratified_sample(spark, sf):
    rows = sliding_rows(spark, sf)
    weights = Lb.inverse_rank_weights(Lb.frequent(Lb.label_counts(rows), 2))
    return joined(Lb.stratified_sample(rows, weights, SHAPES))


def hash_split(spark, sf):
    return Lb.hash_split(sliding_rows(spark, sf), SHAPES).select(*SHAPES, "word", "split")


def top_words(spark, sf):
    counts = Lb.label_counts(P.postings(doc_lines(spark, sf)))
    return R.top(counts, 100, F.desc("count"), F.col("word"))


def words_by_length(spark, sf):
    words = P.postings(doc_lines(spark, sf)).select("word").distinct()
    return words.select("word", F.length("word").alias("n_chars")).orderBy("n_chars", "word")


# vectors

def center_distances(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rounded(D.center_distances(rows, D.center_means(rows)), "distance")


def knn_graph(spark, sf):
    rows = spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
    return rounded(K.knn(rows, 5, key="vec_id", vec="embedding"), "distance")


def emb_random(spark, sf):
    vocab = cut(doc_vocab(spark, sf), "vocab")
    return widened(J.random_vectors(doc_centroids(spark, sf), vocab, dim=EMB_DIM), EMB_DIM)


def conv_random(spark, sf):
    return cut(J.random_vectors(Ce.corpus_centroids(conv_lines(spark, sf)), conv_vocab(spark, sf), dim=VEC_DIM), "vec")


def vec_text_lines(spark, sf):
    return V.vector_lines(conv_random(spark, sf))


def vec_roundtrip(spark, sf):
    path = scratch_path(spark, "vec")
    V.write_vectors(conv_random(spark, sf), path)
    return widened(V.read_vectors(spark, path), VEC_DIM)


def emb_svd(spark, sf):
    return J.svd_vectors(doc_centroids(spark, sf), dim=EMB_DIM)


def emb_nmf(spark, sf):
    return J.nmf_vectors(doc_centroids(spark, sf), dim=EMB_DIM, rounds=10)


def emb_kmeans(spark, sf):
    return J.kmeans_vectors(doc_centroids(spark, sf), dim=EMB_DIM)


def emb_minibatch(spark, sf):
    return J.minibatch_vectors(doc_centroids(spark, sf), dim=EMB_DIM, n_batches=4)


def emb_cf(spark, sf):
    return J.summary_vectors(doc_centroids(spark, sf), cut(doc_vocab(spark, sf), "vocab"), dim=EMB_DIM)


def emb_topics(spark, sf):
    counts = Ce.corpus_centroids(doc_lines(spark, sf), weighting="counts", **PRUNE)
    return J.topic_vectors(counts, dim=EMB_DIM)


def emb_discriminant(spark, sf):
    vocab = cut(doc_vocab(spark, sf), "vocab")
    windows = P.context_windows(doc_lines(spark, sf), exclude=T.stop_words())
    return J.discriminant_vectors(Wt.dealt_tfidf(windows, vocab), vocab, dim=EMB_DIM, known=True)


def emb_graph(spark, sf):
    dense, residual = J.graph_model(doc_centroids(spark, sf), dim=EMB_DIM)
    return L.as_vectors(dense).withColumn("residual", F.lit(residual))


def emb_tangent(spark, sf):
    dense, error, residual = J.tangent_model(doc_centroids(spark, sf), dim=EMB_DIM)
    return L.as_vectors(dense).withColumns({"error": F.lit(error), "residual": F.lit(residual)})


# prediction

def pca_windows(spark, sf):
    return Pr.pca_windows(sliding_rows(spark, sf)).select(*SHAPES, "word", "pca")


def predict_center_lr(spark, sf):
    return Pr.tree_predict(Pr.prepare(sliding_rows(spark, sf), keys=SHAPES))


def predict_center_pca(spark, sf):
    return Pr.tree_predict(Pr.prepare(sliding_rows(spark, sf), keys=SHAPES), num_features=256, components=3)


def predict_center_nb(spark, sf):
    rows = Pr.prepare(Wn.token_windows(conv_lines(spark, sf)), keys=SHAPES, min_count=MIN_COUNT)
    return rounded(Pr.bayes_predict(rows), "score").select(*SHAPES, "word", "pred_word", "score")


def predict_center_ovr(spark, sf):
    rows = Wn.shingle_windows(bench_lines(spark, sf))
    rows = Pr.prepare(rows, keys=SHAPES, min_count=MIN_COUNT, stratified=True)
    return Pr.class_trees_predict(rows, num_features=256)


# streams

def stream_postings(spark, sf):
    docs = table(spark, sf, "documents")
    root = scratch_path(spark, "stream")
    single = any(f.endswith("/documents.parquet") for f in docs.inputFiles())  # one file, not a folder of files
    source, pattern = (sf, "documents.parquet") if single else (f"{sf}/documents.parquet", "*.parquet")
    query = SP.stream_postings(spark, source, docs.schema, f"{root}/out", f"{root}/checkpoint", pattern=pattern)
    query.awaitTermination()
    return SP.read_postings(spark, f"{root}/out")


def stream_sampled_postings(spark, sf):
    docs = table(spark, sf, "documents")
    root = scratch_path(spark, "stream")
    files = parts_for(docs)  # of a batch: at least one per core, and none that grows with the table
    docs.repartition(4 * files, "doc_id").write.parquet(f"{root}/in")
    query = SP.stream_sampled_postings(
        spark, f"{root}/in", docs.schema, f"{root}/out", f"{root}/checkpoint", files_per_trigger=files, merge_every=2)
    query.awaitTermination()
    return SP.read_sampled_postings(spark, f"{root}/out", query.lastProgress["batchId"], merge_every=2)


def stream_centers(spark, sf):
    root = scratch_path(spark, "stream")
    SC.pack(Ce.corpus_centroids(conv_lines(spark, sf))).repartition(4, "word").write.parquet(f"{root}/in")
    query = SC.stream_centers(spark, f"{root}/in", f"{root}/state", f"{root}/checkpoint", VEC_DIM, files_per_trigger=1)
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return SC.read_centers(spark, f"{root}/state", last)[0]


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    corpus_lines, stack_corpora, clean_text, clean_text_short, tokens, tokens_ws, tokens_nostop, char_ngrams,
    postings, postings_lookup, postings_to_lines, coo_codec, sampled_postings, context_windows, kwic_words,
    sliding_windows, sliding_windows_stop, sliding_windows_ascii, sliding_windows_whole, context_windows_all,
    shingle_windows, batch_ids, vocab_size, doc_freq, vocab_pruned, vocab_postings, missing_words,
    windows_per_word, tfidf_windows, tfidf_external_idf, count_windows, window_vectors, word_centroids, hashing_tf,
    plain_idf, sparse_matmul, label_counts, rare_labels, drop_rare, label_index, label_words, label_lookup,
    inverse_rank_weights, stratified_sample, hash_split, top_words, words_by_length, center_distances, knn_graph,
    emb_random, vec_text_lines, vec_roundtrip, emb_svd, emb_nmf, emb_kmeans, emb_minibatch, emb_cf, emb_topics,
    emb_discriminant, emb_graph, emb_tangent, pca_windows, predict_center_lr, predict_center_pca, predict_center_nb, predict_center_ovr,
    stream_postings, stream_sampled_postings, stream_centers,
)}
