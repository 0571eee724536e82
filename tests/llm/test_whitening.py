"""Whitening against a plain version with numpy's own eigensolver."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import eigen, whitening
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def plain_version(rows, k=16):
    """``{key: (n, deviation, |whitened|...)}`` per row, and the explained shares."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) and abs(64 * c) < 2**52 for c in v)]
    dims = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [1_000_000] * (dims - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = np.array([[float(Fraction(n * x[d] - sums[d], n)) for d in range(dims)] for x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for i, x in kept:
        y = np.array([float(Fraction(n * x[d] - sums[d], n)) for d in range(dims)])
        out.append((i, n, sum((n * x[d] - sums[d]) ** 2 for d in range(dims)), y @ (u / np.sqrt(np.maximum(e, 1e-300)))))
    return out, e, float(np.trace(v))


def vectors():
    r = random.Random(8)
    spread = [3 / (1 + d) for d in range(20)]
    rows = [(i, [r.gauss(0.1 * d, spread[d]) for d in range(20)]) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(300)]  # a hot vector counts once
    rows += [(900, None), (901, [0.1, None]), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, [1e300] * 20)]
    rows += [(905, []), (906, [0.25]), (907, [0.0] * 20), (908, [-1e-12] * 20), (None, [0.5] * 20), (7, rows[9][1])]
    return rows


def check(spark, rows, tolerance=1e-7):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(1).alias("x"), F.lit("y").alias("whitened"))
    out, model = whitening.whiten(df, "vec_id", "embedding")
    want, e, trace = plain_version(rows)
    assert model.n == want[0][1]
    assert model.trace == pytest.approx(trace)
    assert model.values == pytest.approx(e, rel=1e-9, abs=1e-9 * e[0])
    got = out.collect()
    assert len(got) == len(want)
    mine = sorted(((cases.key((r.vec_id, r.deviation)), r.whitened) for r in got), key=lambda t: (t[0], [abs(x or 0) for x in t[1]]))
    theirs = sorted(((cases.key((i, d if d < 2**63 else None)), w) for i, _, d, w in want), key=lambda t: (t[0], [abs(x) for x in t[1]]))
    assert [k for k, _ in mine] == [k for k, _ in theirs]
    a = np.array([w[: model.varying] for _, w in mine], float)
    b = np.array([w[: model.varying] for _, w in theirs])
    sign = np.sign((a * b).sum(axis=0))
    assert np.abs(a - b * sign).max() < tolerance
    assert model.identity_error < 1e-9
    return model, got


def test_equals_plain_version(spark):
    model, _ = check(spark, vectors())
    assert model.varying == 16 and model.components.shape == (20, 16)


def test_large_entries_are_exact(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) * 10.0 ** (d + 4) for d in range(5)]) for i in range(50)]
    check(spark, rows, 1e-5)


def test_without_variance(spark):
    r = random.Random(5)
    rows = [(i, [x := r.gauss(0, 1), 2.0, x, 5.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, model = whitening.whiten(df, "vec_id", "embedding")
    assert model.varying == 1 and len(model.values) == 4
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None] * 3 for r in out.collect())
    same = df.select("vec_id", F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"))
    out, model = whitening.whiten(same, "vec_id", "embedding")
    assert model.n == 1 and model.varying == 0 and model.identity_error is None
    assert {(r.deviation, tuple(r.whitened)) for r in out.collect()} == {(0, (None, None))}


def test_empty(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        out, model = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
        assert model is None and out.count() == 0


def test_query(spark, tmp_path):
    got = whitening.op12_whitening(spark, SF).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, e, trace = plain_version(rows)
    assert len(got) == 16 * len(want)
    by = {(r.vec_id, r.component): r for r in got}
    sign = np.sign(sum(np.array([by[i, c + 1].whitened for c in range(16)]) * w for i, _, _, w in want))
    for i, n, deviation, w in want:
        for c in range(16):
            r = by[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened == pytest.approx(w[c] * sign[c], abs=1e-7)
            assert r.explained == pytest.approx(e[c] / trace, rel=1e-9)
            assert r.identity_error < 1e-9
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert whitening.op12_whitening(spark, str(tmp_path)).count() == 0


def matrices():
    r = np.random.default_rng(2)
    yield np.diag([3.0, 3.0, 2.0, 2.0, 2.0, -1.0])  # equal eigenvalues, no coupling
    yield np.ones((7, 7))
    yield np.eye(5) + 1e-9 * np.ones((5, 5))  # a close cluster
    for n in (1, 2, 3, 30, 64):
        a = r.normal(size=(n, n))
        yield a + a.T
        yield a @ np.diag(10.0 ** -np.arange(n).clip(0, 12)) @ a.T
    q, _ = np.linalg.qr(r.normal(size=(12, 12)))
    yield q @ np.diag([5, 5, 5, 4, 4 - 1e-10, 4 - 1e-6, 1, 1, 0.5, 0, 0, 0]) @ q.T


@pytest.mark.parametrize("v", list(matrices()))
def test_eigenpairs(v):
    k = min(16, len(v))
    values, u = eigen.leading_eigenpairs(v, k)
    want = np.linalg.eigvalsh(v)[::-1][:k]
    norm = np.abs(np.linalg.eigvalsh(v)).max()
    assert np.abs(values - want).max() < 1e-13 * norm * len(v)
    assert np.abs(u.T @ u - np.eye(k)).max() < 1e-10
    assert np.abs(v @ u - u * values).max() < 1e-11 * norm


@pytest.mark.parametrize("size", [1, 60, 1000])
def test_exact_products(size):
    r = np.random.default_rng(size)
    for top in (2, 10**4, 2**26, 2**40):
        y = r.integers(-top, top + 1, (size, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(4)] for i in range(4)]
        assert whitening.products(y).tolist() == want
        total = whitening.products(y).ravel()
        parts = whitening.limbs(total)
        assert [sum(int(p[i]) << (whitening.LIMB * at) for at, p in enumerate(parts)) for i in range(len(total))] == total.tolist()
