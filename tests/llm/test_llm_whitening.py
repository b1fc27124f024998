"""Whitening, against dense linear algebra over all rows."""

import math

import numpy as np
import pytest

from plumbline.llm import whitening
from plumbline.llm.common import prepare
from plumbline.llm.queries import QUERIES


def symmetric(kind, n, rng):
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {
        "spread": np.linspace(1, 50, n),
        "clusters": np.repeat([9.0, 9.0 + 1e-9, 4.0, 1.0], -(-n // 4))[:n],
        "equal": np.full(n, 3.0),
        "low rank": np.r_[np.full(2, 7.0), np.zeros(n - 2)] if n > 2 else np.ones(n),
        "steep": np.logspace(0, -8, n),
    }[kind]
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["spread", "clusters", "equal", "low rank", "steep"])
def test_leading_components(kind, n):
    a = symmetric(kind, n, np.random.default_rng(n))
    k = min(n, 32)
    values, vectors = whitening.leading_components(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    norm = np.abs(want).max()
    assert np.abs(values - want).max() <= 1e-13 * norm * n
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * norm * n


def test_leading_components_of_special_matrices():
    for a in (np.zeros((3, 3)), np.diag([5.0, 1.0, 5.0, 0.0]), np.diag([1e-200, 2e-200]), 1e200 * np.ones((4, 4))):
        values, vectors = whitening.leading_components(a, len(a))
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-12
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-13 * np.abs(a).max())


def test_sturm_counts():
    rng = np.random.default_rng(1)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[[4, 11]] = 0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    points = rng.uniform(-4, 4, 50)
    assert whitening.sturm_counts(d, e, points).tolist() == [(values < p).sum() for p in points]


def check(rows, vectors, components=32):
    """``rows`` of the operator against numpy over ``vectors``, a list of (id, vector) of one length."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in vectors], dtype=object)
    n, dims = x.shape
    total = x.sum(axis=0)
    centred = ((n * x - total) / n).astype(float)
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, dims)
    assert len(rows) == n * k
    deviation = [int(d) for d in ((n * x - total) ** 2).sum(axis=1)]
    by_component = [sorted((r for r in rows if r["component"] == c), key=lambda r: r["vec_id"]) for c in range(1, k + 1)]
    order = sorted(range(n), key=lambda i: vectors[i][0])
    got = np.array([[r["whitened"] for r in part] for part in by_component], dtype=float).T
    for c, part in enumerate(by_component):
        assert [r["vec_id"] for r in part] == [vectors[i][0] for i in order]
        assert [r["deviation"] for r in part] == [deviation[i] for i in order]
        assert {r["n"] for r in part} == {n}
        assert part[0]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        want = centred[order] @ axes[:, c] / np.sqrt(values[c])
        gaps = np.abs(np.delete(values, c) - values[c]).min(initial=np.inf) / values[0]
        if gaps > 1e-6:
            assert min(np.abs(got[:, c] - want).max(), np.abs(got[:, c] + want).max()) < 1e-8 / gaps
    error = np.abs(np.cov(got.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-8 and error < 1e-8


def test_query_equals_dense_algebra(spark, sf_dir):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, sf_dir).collect(), table)


def test_odd_rows(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    real = [(i, rng.normal(3, [4, 2, 1, 0.5, 9]).tolist()) for i in range(40)]
    real += [(41, real[0][1]), (41, real[0][1]), (42, [1e3] * 5)]
    odd = [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0]), (52, [float("nan")] * 5), (53, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (54, [])]
    table = spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in real + odd], "vec_id long, embedding array<double>, dim string, n int, w double")
    check(whitening.whiten(table.repartition(7)).collect(), real)


def test_defined_results(spark):
    prepare(spark)
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    alone = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0])], schema)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in sorted(alone, key=lambda r: r["component"])] == [(None, c, 1, 0, None, 0.0) for c in (1, 2)]
    flat = [(i, [float(i), 5.0, -float(i)]) for i in range(8)]  # one direction only
    rows = whitening.whiten(spark.createDataFrame(flat, schema)).collect()
    assert {r["component"] for r in rows if r["whitened"] is not None} == {1} and len(rows) == 24
    assert rows[0]["identity_error"] < 1e-8
    mixed = [(i, [float(i % 3), float(i % 5)]) for i in range(30)] + [(100 + i, [float(i**2), float(i), 1.0 / (i + 1)]) for i in range(9)]
    rows = whitening.whiten(spark.createDataFrame(mixed, schema)).collect()
    check([r for r in rows if r["vec_id"] < 100], [(i, np.float32(v).tolist()) for i, v in mixed if i < 100])
    check([r for r in rows if r["vec_id"] >= 100], [(i, np.float32(v).tolist()) for i, v in mixed if i >= 100])


def test_large_values_stay_exact(spark):
    """Products beyond 64 bits on the way to the deviation."""
    prepare(spark)
    values = [(i, [(-1) ** i * (1e9 + i), 3e8 * i]) for i in range(50)]
    check(whitening.whiten(spark.createDataFrame(values, "vec_id long, embedding array<double>")).collect(), values)
