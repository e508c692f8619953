import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecindario.llm import ordering as O, tokens

PATH = tokens.default_path()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(O.feistel(F.col("id"), n).alias("s")).collect()]
    assert sorted(got) == list(range(n))
    if n > 60:
        other = [r[0] for r in spark.range(n).select(O.feistel(F.col("id"), n, key=7).alias("s")).collect()]
        assert got != other and got != list(range(n))


TEXTS = [None, "", "hello"] + [f"text {i} with some words {i * i} " * (i % 30) for i in range(200)]


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, tmp_path, parts):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string, shard int").repartition(parts)
    path, length, per = f"file://{tmp_path}/out", 32, 20
    out = sorted(O.materialise(df, PATH, path, length=length, per_shard=per).collect(), key=lambda r: r.slot)
    n = len(out)
    assert [r.slot for r in out] == list(range(n)) and sorted(r.sequence_id for r in out) == list(range(n))
    assert all(r.shard == r.slot // per and r.record == r.slot % per for r in out)
    files = sorted(f for f in os.listdir(tmp_path / "out") if not f.endswith(".crc"))
    assert files == [O.file_name(i) for i in range(-(-n // per))]
    raw = b"".join((tmp_path / "out" / f).read_bytes() for f in files)
    assert len(raw) == n * 2 * length
    assert [r.ids_crc32 for r in out] == [zlib.crc32(raw[i * 64:(i + 1) * 64]) for i in range(n)]
    encode, end = tokens.Chunks(PATH).encode, np.array([O.END_TOKEN], "<u2").tobytes()
    total = sum(len(encode(t)) // 2 + 1 for t in TEXTS)
    assert sum(r.n_tokens for r in out) == total
    ids = sorted(np.frombuffer(b"".join(raw[r.slot * 64:r.slot * 64 + 2 * r.n_tokens] for r in out), "<u2").tolist())
    assert ids == sorted(np.frombuffer(b"".join(encode(t) + end for t in TEXTS), "<u2").tolist())
    first = n // 2
    read = O.read_records(spark, path, first, length=length, per_shard=per).collect()
    assert {r.slot: bytes(r.ids) for r in read} == {s: raw[s * 64:(s + 1) * 64] for s in range(first, n)}


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert O.materialise(df, PATH, f"file://{tmp_path}/none").count() == 0
