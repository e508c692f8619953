"""Keep a postings table up to date from a growing folder of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.postings import LINE_KEYS, postings, sample
from ..sources.corpus import lines_from_column


def stream_postings(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, *,
                    files_per_trigger: int = 100, pattern: str = "*.parquet", text: str = "text") -> StreamingQuery:
    """Append the postings of each new file once; stateless, so it needs no watermark.

    Processes what is there and stops; run it again to take in what came since.
    """
    docs = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern).parquet(source)
    )
    posts = postings(lines_from_column(docs, text=text))
    return (
        posts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def read_postings(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)


def _sample_paths(out: str, batch: int, merge_every: int) -> list[str]:
    """The last merged table up to ``batch`` and the tables of the batches after it."""
    merged = (batch + 1) // merge_every * merge_every - 1
    return [f"{out}/merged/batch={merged}"] * (merged >= 0) + [
        f"{out}/fresh/batch={b}" for b in range(merged + 1, batch + 1)]


def stream_sampled_postings(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, *,
                            samples: int = 50, seed: int = 42, merge_every: int = 16, files_per_trigger: int = 100,
                            pattern: str = "*.parquet", text: str = "text") -> StreamingQuery:
    """Keep each word's ``samples`` postings of lowest hash over a growing folder of documents.

    The lowest of a union are among the lowest of its parts, so a batch stores only its own sample, and every
    ``merge_every`` batches the stored ones are merged into one table. A batch reads tables of earlier batches and
    overwrites its own, so a replay changes nothing; a frequent word sends ``samples`` rows per task, not all its
    postings, which per-word state would receive.
    """
    if samples <= 0 or merge_every <= 0:
        raise ValueError("samples and merge_every must be positive")

    def update(docs: DataFrame, batch: int) -> None:
        fresh = sample(postings(lines_from_column(docs, text=text)), samples, seed=seed)
        fresh.write.mode("overwrite").parquet(f"{out}/fresh/batch={batch}")
        if (batch + 1) % merge_every == 0:
            session = docs.sparkSession
            paths = [f"{out}/fresh/batch={batch}"]
            if batch:
                paths = _sample_paths(out, batch - 1, merge_every) + paths
            parts = session.read.schema(fresh.schema).parquet(*paths)
            sample(parts, samples, seed=seed).write.mode("overwrite").parquet(f"{out}/merged/batch={batch}")

    docs = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", pattern).parquet(source)
    )
    return (
        docs.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_sampled_postings(spark: SparkSession, out: str, batch: int, *, samples: int = 50, seed: int = 42,
                          merge_every: int = 16) -> DataFrame:
    """``(word, doc_id, line_no, offset)`` after ``batch``: what ``sample`` gives over all documents so far."""
    parts = spark.read.parquet(*_sample_paths(out, batch, merge_every))
    return sample(parts.select("word", *LINE_KEYS, "offset"), samples, seed=seed)
