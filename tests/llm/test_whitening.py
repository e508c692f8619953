import math

import numpy as np
import pytest

from vecindario.llm import queries, whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n long, whitened string"


def brute(vectors, components=4):
    """vec_id -> (deviation, whitened up to sign), eigenvalue shares, n; by whole numbers and a dense solver."""
    good = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(z.T @ z / n)
    values, axes = values[::-1], axes[:, ::-1]
    rows = []
    for k, x in good:
        off = [n * a - s for a, s in zip(x, sums, strict=True)]
        rows.append((k, sum(a * a for a in off), (np.array(off) / n) @ axes[:, :components] / np.sqrt(values[:components])))
    return n, values / values.sum(), rows


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 0, 7, "x") for k, v in vectors], SCHEMA).repartition(3)


def vectors(seed=3, rows=400, dims=7):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((rows, dims)) @ (rng.standard_normal((dims, dims)) * np.arange(1, dims + 1)) + 5
    out = [(i, [float(c) for c in row]) for i, row in enumerate(mixed)]
    hot = out[0][1]
    out += [(1000 + i, hot) for i in range(200)] + [(0, hot), (None, out[1][1])]
    return out + [(2000, None), (2001, [None] + [1.0] * (dims - 1)), (2002, [float("nan")] + [1.0] * (dims - 1)), (2003, [float("inf")] * dims)]


def test_equals_a_dense_solver(spark):
    rows = vectors()
    n, shares, want = brute(rows)
    got = {}
    for r in W.whiten(frame(spark, rows)).collect():
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-9)
        got.setdefault((r.vec_id, r.deviation), []).append((r.component, r.whitened))
    assert set(got) == {(k, d) for k, d, _ in want}
    sign = None
    for k, d, white in want:
        found = np.array([w for _, w in sorted(set(got[k, d]))])
        sign = np.sign(found * white) if sign is None else sign
        assert found * sign == pytest.approx(white, abs=1e-8)
    assert sum(len(v) for v in got.values()) == 4 * len(want)


def test_ranks_sizes_and_nothing(spark):
    flat = W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (3, [1.0])])).collect()
    assert len(flat) == 6 and {r.n for r in flat} == {3}
    line = W.whiten(frame(spark, [(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0])])).collect()
    assert [(r.vec_id, r.component, r.whitened is None) for r in sorted(line)] == [(i, c, c > 1) for i in (1, 2) for c in (1, 2, 3)]
    assert all(abs(r.whitened) == pytest.approx(1) and r.explained == pytest.approx(1) for r in line if r.component == 1)
    same = W.whiten(frame(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(same) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in same)
    assert W.whiten(frame(spark, [(1, None)])).collect() == [] and W.whiten(frame(spark, [(1, [])])).collect() == []
    assert W.whiten(frame(spark, []).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e6, -2.0]), (2, [-3e6, 1.0]), (3, [0.5, 0.25]), (4, [1e30, 0.0])]
    _, _, want = brute(rows[:3], 2)
    assert {r.vec_id: r.deviation for r in W.whiten(frame(spark, rows[:3])).collect()} == {k: d for k, d, _ in want}
    out = W.whiten(frame(spark, rows)).collect()
    assert {r.vec_id for r in out} == {1, 2, 3, 4} and all(r.deviation is None for r in out if r.vec_id == 4)


def test_does_not_depend_on_partitions(spark):
    rows = vectors(5)
    one, many = (sorted(map(tuple, W.whiten(frame(spark, rows).filter("vec_id is not null").repartition(p)).collect())) for p in (1, 8))
    assert [r[:4] for r in one] == [r[:4] for r in many]
    assert np.array([r[4:] for r in one]) == pytest.approx(np.array([r[4:] for r in many]), abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_tournament_holds_each_pair_once(n):
    pairs = [(int(a), int(b)) for p, q in W.tournament(n) for a, b in zip(p, q, strict=True)]
    assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    basis, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    true = 10.0 ** -np.arange(12)
    v = basis * true @ basis.T
    factor = W.pivoted_cholesky(v)
    assert factor @ factor.T == pytest.approx(v, abs=1e-15)
    values, vectors_ = W.one_sided_jacobi(factor)
    assert values[:8] == pytest.approx(true[:8], rel=1e-6)
    assert vectors_.T @ vectors_ == pytest.approx(np.eye(vectors_.shape[1]), abs=1e-13)


def test_query_on_the_supplied_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, shares, want = brute(rows)
    got = queries.QUERIES["op11_embedding_whitening"](spark, sf).collect()
    assert {(r.vec_id, r.n, r.deviation) for r in got} == {(k, n, d) for k, d, _ in want} and len(got) == 4 * len(want)
    white = {k: w for k, _, w in want}
    assert all(abs(r.whitened) == pytest.approx(abs(white[r.vec_id][r.component - 1]), abs=1e-7) for r in got)
    assert max(r.identity_error for r in got) < 1e-9
