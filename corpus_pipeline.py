"""A training corpus in five stages, each on everything that the one before it kept.

Documents that the quality classifier or the language identification rejects go, one document of each class of near
duplicates stays, documents that hold a benchmark item go, and the rest is packed into sequences.

Stages that add columns of their own carry the document as one struct, so a column of any name passes through unchanged.
Null and empty texts have a quality score but no language, so the second stage rejects them; very long texts are taken
whole; repeated rows are copies, one of them stays; an empty table stays empty, and with no label or no language to learn
from the classifier scores all rows alike and the language stage keeps all rows. Of equal scores none is preferred: the
limits alone decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vecindario.llm import decontamination, language, near_duplicates, packing, quality_model, tokens
from vecindario.session import cut, scratch_path

#: Documents scored below are rejected: more likely bad than good, and in no language that is likelier than all others together.
MIN_QUALITY = 0.5
MIN_LANGUAGE = 0.5
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Send whole texts to the tasks' Python in smaller batches, unless the session says how large they are."""
    if spark.conf.get(BATCH_ROWS) == "10000":  # Spark's own default
        spark.conf.set(BATCH_ROWS, "1000")


def carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The whole row as ``_row``, and beside it the columns that a stage works on."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *needed)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that the classifier, fitted on labelled rows of ``docs``, scores below ``MIN_QUALITY``."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    labels = labels.filter(~quality_model.held_out(F.col("doc_id")))
    stats = cut(quality_model.described(docs.select("doc_id", "text")), "stats")
    model = quality_model.fit(cut(stats.join(labels, "doc_id"), "training"))
    scored = quality_model.scored(quality_model.described(carried(docs, "text"), "text"), model)
    return scored.filter(F.col("score") >= MIN_QUALITY).select("_row.*")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a letter or whose likeliest language scores below ``MIN_LANGUAGE``."""
    small_batches(spark)
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    found = language.predicted(carried(docs, "text"), model, "text")
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)).select("_row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of copies and near copies."""
    small_batches(spark)
    return near_duplicates.firsts(carried(docs, "doc_id", "text")).select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that hold a benchmark item."""
    small_batches(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places."""
    small_batches(spark)
    return packing.pack(packing.token_pieces(docs, tokens.default_path()))


STAGES = [("quality classifier", quality), ("language ID", languages), ("MinHash near-dedup", near_duplicate),
          ("benchmark decontamination", decontaminate), ("best-fit packing", packed)]
#: Learned models, sketches and token ids can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
