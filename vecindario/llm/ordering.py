"""Training-order materialisation: sequences of equal stride in a keyed pseudo-random order.

1. Token ids (16 bit, an end token after each document) of a task's documents run on through sequences of
   ``length`` ids; only the last sequence of a task is padded, with end tokens.
2. Every sequence gets a global number, and the number a global slot by a keyed Feistel permutation of the next
   power of four, walked on until it falls below the number of sequences. No sort decides the order, so any
   task can compute any slot.
3. Sequences are range-partitioned by shard and written in slot order as files of fixed-stride records: slot s
   is record ``s % per_shard`` of file ``s // per_shard``, so a reader resumes at any slot by a seek.

A file is written under a name of its own and renamed, so retried or doubled tasks leave one whole file.

Edge cases: null and empty texts are one end token; repeated rows are written one by one; an empty table gives
no sequence and no file; a very long text runs on through as many sequences as it fills; only the text is read, so other
columns may have any name. Slots have no ties. Sequences are numbered along the input's partitions: another split of the same
table gives other sequences and another order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import cut
from . import tokens
from .dense import placed

LENGTH = 2048
PER_SHARD = 4096
KEY = 20240229
ROUNDS = 6
END_TOKEN = 49407  # the file's end of text

SEQUENCE = T.StructType([T.StructField("_all", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("packed", T.BinaryType()),
                         T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])


def codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def sequences(documents: DataFrame, tokenizer: str, length: int = LENGTH, end_token: int = END_TOKEN, text: str = "text") -> DataFrame:
    """One row per sequence, numbered by ``sequence_id``: the ids (compressed) and how many are not padding."""
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = tokens.chunks(tokenizer).encode, np.array([end_token], dtype="<u2").tobytes()
        stride, rest, pack = 2 * length, b"", codec()
        part, done = TaskContext.get().partitionId(), 0

        def rows(whole: bytes, sizes: list[int]) -> pa.RecordBatch:
            parts = [pack.compress(whole[i * stride:(i + 1) * stride], asbytes=True) for i in range(len(sizes))]
            local = pa.array(range(done, done + len(sizes)), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([0] * len(sizes), pa.int32()), pa.array(sizes, pa.int32()), pa.array(parts, pa.binary()),
                                               pa.array([part] * len(sizes), pa.int32()), local], names=SEQUENCE.names)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                run = [rest]
                for body in batch.column(0).slice(start, 256):
                    run += (encode(body.as_py()), last)
                run = b"".join(run)
                n = len(run) // stride
                rest = run[n * stride:]
                if n:
                    yield rows(run, [length] * n)
                    done += n
        if rest:
            yield rows(rest + last * (length - len(rest) // 2), [len(rest) // 2])

    # the task that cuts also counts, so no second Python worker passes the sequences on
    counted = cut(documents.select(text).mapInArrow(cut_up, SEQUENCE), "numbered")
    return placed(counted, "_all", "sequence_id", few=True).drop("_all")


def feistel(number: Column, n: int, key: int = KEY, rounds: int = ROUNDS) -> Column:
    """The slot of each number of 0..n-1: a permutation of that range that depends on ``key``.

    Two halves of equal width are mixed ``rounds`` times by a hash of one half; results at or above n are
    permuted again. The domain is less than four times n, and a walk that leaves 0..n-1 comes back, as each step
    is a permutation of the domain.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def slots(column: pa.Array) -> np.ndarray:
        x = column.to_numpy(zero_copy_only=False).astype(np.uint64)
        out = walk(x)
        while len(outside := np.flatnonzero(out >= n)):
            out[outside] = walk(out[outside])
        return out

    def walk(x):
        from .textarrays import mixed
        left, right = x >> np.uint64(half), x & np.uint64(mask)
        for r in range(rounds):
            salt = mixed(np.array([key * 1_000_003 + r], dtype=np.uint64))[0]
            left, right = right, left ^ (mixed(right + salt) & np.uint64(mask))
        return left << np.uint64(half) | right

    @F.arrow_udf("bigint")
    def slot(values: pa.Array) -> pa.Array:
        return pa.array(slots(values).astype(np.int64))

    return slot(number)


def write_shards(rows: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write rows of ``sequences`` with a ``slot`` as record files below ``path``; one row per record, as written.

    The files are written when the result is read; ``path`` is a folder that all executors share.
    """
    schema = T.StructType([T.StructField(c, t) for c, t in (("slot", T.LongType()), ("sequence_id", T.LongType()), ("shard", T.LongType()),
                                                            ("record", T.LongType()), ("n_tokens", T.IntegerType()), ("ids_crc32", T.LongType()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = pyarrow.fs.FileSystem.from_uri(path)
        system.create_dir(folder, recursive=True)
        pack = codec()
        own, open_shard, sink = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}", None, None

        def close():
            if sink is not None:
                sink.close()
                system.move(f"{folder}/.{open_shard}-{own}", f"{folder}/{file_name(open_shard)}")

        for batch in batches:
            slot, number, size, packed = (batch.column(batch.schema.get_field_index(c)) for c in ("slot", "sequence_id", "n_tokens", "packed"))
            slots, crcs = slot.to_numpy(), []
            for shard, ids in zip((slots // per_shard).tolist(), packed, strict=True):
                if shard != open_shard:
                    close()
                    open_shard, sink = shard, system.open_output_stream(f"{folder}/.{shard}-{own}")
                raw = pack.decompress(ids.as_buffer(), decompressed_size=2 * length, asbytes=True)
                crcs.append(zlib.crc32(raw))
                sink.write(raw)
            yield pa.RecordBatch.from_arrays([slot, number, pa.array(slots // per_shard), pa.array(slots % per_shard), size, pa.array(crcs, pa.int64())], names=schema.names)
        close()

    count = rows.count()
    shards = max(1, -(-count // per_shard))
    by_shard = rows.withColumn("_shard", F.floor(F.col("slot") / per_shard))
    dealt = by_shard.repartitionByRange(shards, "_shard").sortWithinPartitions("slot")
    return dealt.select("slot", "sequence_id", "n_tokens", "packed").mapInArrow(write, schema)


def file_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_records(spark: SparkSession, path: str, first_slot: int = 0, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """(slot, ids as binary) from ``first_slot`` on; whole earlier files are not opened."""
    stride, first_file = 2 * length, file_name(first_slot // per_shard)
    names = F.regexp_extract("path", r"shard-(\d+)\.bin$", 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path)
    files = files.filter(F.concat(F.lit("shard-"), names, F.lit(".bin")) >= first_file)
    record = F.explode(F.sequence(F.lit(0), (F.col("length") / stride).cast("int") - 1))
    rows = files.select("content", names.cast("bigint").alias("shard"), record.alias("record"))
    rows = rows.select((F.col("shard") * per_shard + F.col("record")).alias("slot"),
                       F.substring("content", F.col("record") * stride + 1, F.lit(stride)).alias("ids"))
    return rows.filter(F.col("slot") >= first_slot)


def materialise(documents: DataFrame, tokenizer: str, path: str, key: int = KEY, length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """All steps; the result has one row per sequence and is written to ``path`` as it is read."""
    rows = cut_slots(sequences(documents, tokenizer, length), key)
    return write_shards(rows, path, length, per_shard)


def cut_slots(rows: DataFrame, key: int) -> DataFrame:
    return rows.withColumn("slot", feistel(F.col("sequence_id"), rows.count(), key))
