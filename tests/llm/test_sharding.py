import collections
import random
import zlib

import numpy as np
import pytest

from vecindario.llm import sharding as S


def table(spark, texts, parts=3):
    rows = [(i, t, "x", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string, size int").repartition(parts)


def checked(spark, texts):
    out = S.assign(S.measured(table(spark, texts))).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    slots = collections.defaultdict(list)
    for r in out:
        body = (texts[r.doc_id] or "").encode()
        assert r.size == len(body) + 1 and r.text_crc32 == zlib.crc32(body) and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return out


def test_bytes_are_near_equal_and_groups_stay_whole(spark):
    random.seed(1)
    texts = ["word " * random.randint(1, 200) + str(i) for i in range(3000)] + ["same text"] * 5 + [None, "", "é\n"]
    out = checked(spark, texts)
    load = collections.Counter()
    for r in out:
        load[r.shard] += r.size
    assert max(load.values()) <= 1.01 * min(load.values())
    assert len({r.shard for r in out if texts[r.doc_id] == "same text"}) == 1
    assert len({r.shard for r in out if not texts[r.doc_id]}) == 1


def test_a_group_of_a_third_of_all_rows_is_split(spark):
    texts = ["the hot text, again and again"] * 2000 + [f"text number {i} is here" for i in range(4000)]
    load, rows = collections.Counter(), collections.Counter()
    for r in checked(spark, texts):
        load[r.shard] += r.size
        rows[r.shard] += 1
    assert max(load.values()) <= 1.02 * min(load.values()) and max(rows.values()) <= 1.1 * min(rows.values())


def test_only_groups_beyond_a_shard_are_split(spark):
    rng = random.Random(7)
    texts = [f"text {i} " + "word\n" * rng.randint(0, 60) for i in range(2500)]
    for k, n in enumerate((2, 3, 20, 60, 150, 300)):
        texts += [f"group {k} " + "copied\t" * (10 + 5 * k)] * n
    rng.shuffle(texts)
    load, shards, rows, tokens = collections.Counter(), collections.defaultdict(set), collections.Counter(), collections.Counter()
    for r in checked(spark, texts):
        shards[texts[r.doc_id]].add(r.shard)
        load[texts[r.doc_id]] += r.size
        rows[r.shard] += 1
        tokens[r.shard] += r.tokens
    total, copies = sum(load.values()), collections.Counter(texts)
    assert all(len(s) == 1 for t, s in shards.items() if load[t] <= total / 16 and copies[t] <= len(texts) / 16)
    assert max(tokens.values()) <= 1.05 * min(tokens.values())


def naive(vectors, shards):
    """The same rule written out with plain loops."""
    total = [sum(v[d] for v in vectors) or 1 for d in range(3)]
    scaled = [[v[d] / total[d] * shards for d in range(3)] for v in vectors]
    residual, out = [[1.0] * 3 for _ in range(shards)], {}
    for i in sorted(range(len(vectors)), key=lambda i: (-max(scaled[i]), i)):
        dots = [sum(r[d] * scaled[i][d] for d in range(3)) for r in residual]
        fits = [s for s in range(shards) if all(residual[s][d] >= scaled[i][d] for d in range(3))] or range(shards)
        best = max(fits, key=lambda s: (dots[s], -s))
        residual[best] = [residual[best][d] - scaled[i][d] for d in range(3)]
        out[i] = best
    return [out[i] for i in range(len(vectors))]


def test_placing_equals_plain_loops(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.lognormal(0, 1.5, (400, 3))
    vectors[50:60] = vectors[50]  # ties
    monkeypatch.setattr(S, "levelled", lambda scaled, residual, out: out)
    assert S.place(vectors, 8).tolist() == naive(vectors.tolist(), 8)


def test_levelling_never_widens_a_gap():
    rng = np.random.default_rng(4)
    vectors = rng.lognormal(0, 1, (3000, 3))
    loads = np.array([vectors[S.place(vectors, 16) == s].sum(axis=0) for s in range(16)]) / vectors.sum(axis=0) * 16
    assert np.ptp(loads, axis=0).max() < 0.01


def test_small_and_empty_tables(spark):
    checked(spark, ["a"])
    checked(spark, [None, None])
    assert S.assign(S.measured(table(spark, ["x"]).limit(0))).count() == 0


def test_dot_product_rule():
    out = S.place(np.array([[8.0, 1.0], [1.0, 8.0], [8.0, 1.0], [1.0, 8.0]]), 2)
    assert out[0] != out[2] and out[1] != out[3]


@pytest.mark.parametrize("units", [0, 1, 15, 500])
def test_place_uses_every_unit(units):
    assert len(S.place(np.ones((units, 3)), 16)) == units
