"""Embedding whitening: leading components of the covariance of distinct vectors, each scaled to unit variance.

1. Vectors become whole numbers; equal ones count once (the fit list).
2. Sums per dimension give the centre, rounded to whole numbers; every task adds
   up the products of its centred vectors exactly, so neither the order of the
   additions nor the number of tasks changes the covariance.
3. The covariance, one number per pair of dimensions, is reduced to tridiagonal
   form by Householder reflections; bisection over Sturm counts finds its leading
   eigenvalues, inverse iteration the vectors, made orthogonal within clusters.
4. The components are broadcast and every vector is projected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .eigen import EPS, leading_eigenpairs
from .registry import register, table

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 52)  # scaled entries from here on leave out their row
LIMB = 31  # bits of a part of a whole number that is added up
EXACT = 1 << 53  # sums of products up to here are exact in doubles


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE, shift: int = SHIFT) -> tuple[DataFrame, int]:
    """``(vec_id, x)`` with x = floor(scale * c) + shift, and the number of dimensions; shorter vectors end in c = 0."""
    e = F.col(embedding)
    whole = e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LARGEST))
    kept = vectors.filter(whole)
    dims = kept.agg(F.max(F.size(e))).first()[0] or 0
    x = F.transform(e, lambda c: F.floor(c.cast("double") * scale).cast("bigint") + shift)
    x = F.concat(x, F.array_repeat(F.lit(shift).cast("bigint"), F.lit(dims) - F.size(e)))
    return kept.select(F.col(vec_id).cast("bigint").alias("vec_id"), x.alias("x")), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """One row per vector."""
    return column.flatten().to_numpy().reshape(len(column), dims)


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as parts of LIMB bits, lowest first, the last one signed."""
    out = []
    while True:
        high = values >> LIMB
        if not out or bool(np.any((values != 0) & (values != -1))):
            out.append((values - (high << LIMB)).astype(np.int64))
            values = high
        else:
            out.append(values.astype(np.int64))
            return out


def limb_batch(keys: list[np.ndarray], values: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for at, part in enumerate(limbs(values)):
        columns = [pa.array(k.astype(np.int32)) for k in keys] + [pa.array(np.full(len(part), at, np.int32)), pa.array(part)]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "limb", "value"])


def whole(rows: list, width: int) -> dict:
    """Whole numbers by key from the ``(key..., limb, value)`` rows."""
    out: dict = {}
    for r in rows:
        key = tuple(r[:width])
        out[key] = out.get(key, 0) + (int(r[width + 1]) << (LIMB * r[width]))
    return out


def sums_of(fit: DataFrame, dims: int) -> list[int]:
    """The sum of each dimension, exact."""

    def add(batches):
        total = np.zeros(dims, object)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            high = x >> LIMB
            total = total + (high.sum(axis=0).astype(object) << LIMB) + (x - (high << LIMB)).sum(axis=0).astype(object)
        yield from limb_batch([np.arange(dims)], total, ["i"])

    rows = fit.select("x").mapInArrow(add, "i int, limb int, value long").groupBy("i", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect()
    found = whole(rows, 1)
    return [found.get((i,), 0) for i in range(dims)]


def products(y: np.ndarray) -> np.ndarray:
    """Sums of products of the columns, exact, as whole numbers."""
    most = int(np.abs(y).max(initial=0)) ** 2
    if most * len(y) <= EXACT:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    if 2 * most <= EXACT:
        step = EXACT // most
        return reduce(np.add, (products(y[i : i + step]) for i in range(0, len(y), step)))
    wide = y.astype(object)
    return wide.T @ wide


def product_sums(fit: DataFrame, centre: list[int]) -> dict:
    """Sums of products of centred dimensions by ``(i, j)``, i <= j, exact."""
    dims = len(centre)
    shared = fit.sparkSession.sparkContext.broadcast(np.array(centre, np.int64))
    upper = np.triu_indices(dims)

    def add(batches):
        total = np.zeros((dims, dims), object)
        for batch in batches:
            total = total + products(matrix(batch.column(0), dims) - shared.value)
        yield from limb_batch(list(upper), total[upper], ["i", "j"])

    rows = fit.select("x").mapInArrow(add, "i int, j int, limb int, value long")
    return whole(rows.groupBy("i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect(), 2)


@dataclass
class Whitening:
    """What is fitted: ``n`` distinct vectors with ``sums``, and the leading ``components`` (columns) of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def centre(self) -> list[int]:
        return [round_half_down(s, self.n) for s in self.sums]

    @property
    def scaled(self) -> np.ndarray:
        """Components over the square roots of their eigenvalues; those without variance are left out."""
        return self.components[:, : self.varying] / np.sqrt(self.values[: self.varying])

    @property
    def varying(self) -> int:
        """Components whose variance is more than rounding."""
        least = len(self.sums) * EPS * (self.values[0] if len(self.values) else 0.0)
        return int((self.values > least).sum())


def round_half_down(s: int, n: int) -> int:
    return -((n - 2 * s) // (2 * n))


def centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - sums, exact."""
    centre = np.array(model.centre, np.int64)
    y = x - centre
    rest = np.array([s - model.n * c for s, c in zip(model.sums, model.centre, strict=True)], object)
    if int(np.abs(y).max(initial=0)) * model.n + model.n < 1 << 62:
        return y * model.n - rest.astype(np.int64)
    return y.astype(object) * model.n - rest


def fit_whitening(fit: DataFrame, dims: int, k: int = COMPONENTS) -> Whitening | None:
    """The whitening of the rows of ``fit``, each a whole vector ``x``; none without rows or dimensions."""
    n = fit.count()
    if not n or not dims:
        return None
    model = Whitening(n, sums_of(fit, dims), np.zeros(0), np.zeros((dims, 0)), 0.0)
    found = product_sums(fit, model.centre)
    rest = [s - n * c for s, c in zip(model.sums, model.centre, strict=True)]
    v = np.zeros((dims, dims))
    for (i, j), s in found.items():
        v[i, j] = v[j, i] = (n * s - rest[i] * rest[j]) / (n * n)  # a quotient of whole numbers, rounded once
    model.trace = float(sum(n * found[i, i] - rest[i] ** 2 for i in range(dims)) / (n * n))
    model.values, model.components = leading_eigenpairs(v, k)
    model.identity_error = identity_error(fit, model)
    return model


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest difference between the covariance of the whitened fit list and the identity."""
    k = model.varying
    if not k:
        return None
    shared = fit.sparkSession.sparkContext.broadcast(model)

    def add(batches):
        model = shared.value
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = whitened(centred(matrix(batch.column(0), len(model.sums)), model), model)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "value"])

    total = np.zeros((k + 1, k))
    for i, j, value in fit.select("x").mapInArrow(add, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():
        total[i, j] = value / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(numerators: np.ndarray, model: Whitening) -> np.ndarray:
    return (numerators.astype(float) / model.n) @ model.scaled


def deviations(numerators: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; null where no long holds one."""
    most = int(np.abs(numerators).max(initial=0))
    if most * most * numerators.shape[1] < 1 << 62:
        return (numerators * numerators).sum(axis=1).tolist()
    sums = (numerators.astype(object) ** 2).sum(axis=1)
    return [int(s) if s < 1 << 63 else None for s in sums]


def whiten(
    vectors: DataFrame, vec_id: str, embedding: str, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> tuple[DataFrame, Whitening | None]:
    """``(vec_id, deviation, whitened)`` per kept row, and what was fitted.

    ``whitened`` holds one DOUBLE per component (k, or the number of dimensions if
    less); null for a component without variance, as of vectors that are all
    equal.  ``deviation`` is the sum over dimensions of (n * x - sum)**2, null if
    no long holds it.

    Left out are rows whose vector is null, holds null or non-finite entries, or
    entries beyond 2**52 / scale.  Of different lengths the shorter is filled up
    with zeros.  Equal vectors count once in the fit and each gets its row; rows
    without id stay; other columns are ignored; without rows or dimensions the
    result is empty and nothing is fitted.
    """
    rows, dims = whole_vectors(vectors, vec_id, embedding, scale, shift)
    schema = "vec_id long, deviation long, whitened array<double>"
    model = fit_whitening(materialise(rows.select("x").distinct(), "distinct_vectors"), dims, k) if dims else None
    if model is None:
        return rows.sparkSession.createDataFrame([], schema), None
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def project(batches):
        model = shared.value
        width, filled = len(model.values), model.varying
        for batch in batches:
            numerators = centred(matrix(batch.column(1), len(model.sums)), model)
            w = np.zeros((len(numerators), width))
            w[:, :filled] = whitened(numerators, model)
            without = np.zeros(w.shape, bool)
            without[:, filled:] = True
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * width)
            column = pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), mask=without.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(numerators), pa.int64()), column], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(project, schema), model


@register("op12_whitening")
def op12_whitening(spark, sf_dir: str) -> DataFrame:
    rows, model = whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    share = [float(e) / model.trace if model.trace else None for e in model.values] if model else []
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(s).cast("double") for s in share]) if share else F.lit(None).cast("array<double>")
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
