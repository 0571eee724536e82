"""Points within a radius by halved cells, against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import points as pt


def frame(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id bigint, x double, y double, z double")


def brute_components(xyz, radius):
    least = list(range(len(xyz)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(xyz)):
        for j in np.flatnonzero(np.sqrt(((xyz[i + 1 :] - xyz[i]) ** 2).sum(axis=1)) <= radius) + i + 1:
            a, b = root(i), root(int(j))
            least[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(xyz))}


def clouds():
    r = np.random.default_rng(1)
    yield r.normal(size=(300, 3)), 0.35
    yield np.concatenate([r.normal(size=(200, 3)) * 0.02, r.normal(size=(200, 3)) * 0.02 + [0.2, 0, 0]]), 0.1
    yield np.concatenate([np.zeros((50, 3)), np.full((50, 3), 1.0)]), math.sqrt(3.0)  # equal points at the very radius
    yield np.array([[x, y, 0.0] for x in range(8) for y in range(8)]) * 0.5, 0.5


@pytest.mark.parametrize("case", range(4))
def test_components(spark, case, monkeypatch):
    monkeypatch.setattr(pt, "FEW", 2)  # halve down to single points
    xyz, radius = list(clouds())[case]
    got = {r.id: r.component for r in pt.radius_components(frame(spark, xyz), radius).collect()}
    assert got == brute_components(xyz, radius)


@pytest.mark.parametrize("gap", [0.9, 1.1])
def test_near_points(spark, gap):
    """Every left point with a right one within the radius, on two facing sheets and a cloud."""
    r = np.random.default_rng(2)
    left = np.concatenate([r.uniform(0, 1, (150, 3)) * [1, 1, 0.01], r.normal(size=(50, 3))])
    right = np.concatenate([r.uniform(0, 1, (150, 3)) * [1, 1, 0.01] + [0, 0, gap], r.normal(size=(50, 3))])
    side = 1.0 / math.sqrt(3.0)
    one, two = (pt._placed(frame(spark, x), side, ["id"]) for x in (left, right))
    pairs = one.select(F.col("root").alias("root_a")).distinct().crossJoin(two.select(F.col("root").alias("root_b")).distinct())
    got = {x.id for x in pt.near_parts(pairs, one, two.drop("id"), 1.0, each=True).collect()}
    apart = np.sqrt(((left[:, None] - right[None]) ** 2).sum(axis=2)).min(axis=1)
    assert got == {int(i) for i in np.flatnonzero(apart <= 1.0)}


@pytest.mark.parametrize("gap", [0.97, 1.03])
def test_two_full_cells(spark, monkeypatch, gap):
    """Two cells of 100,000 points, a little nearer or farther than the radius, without millions of pairs."""
    rows = []
    written = pt.materialise
    monkeypatch.setattr(pt, "materialise", lambda df, name, by=(): rows.append((name, written(df, name, by))) or rows[-1][1])
    n, far = 100_000, 0.5 + gap
    cell = lambda seed, at: spark.range(n).select((F.col("id") + (seed << 32)).alias("id"), (F.rand(seed) * 0.5 + at).alias("x"), (F.rand(seed + 1) * 0.5).alias("y"), (F.rand(seed + 2) * 0.5).alias("z"))
    xyz = written(cell(1, 0.01).unionByName(cell(9, far + 0.01)), "points")
    parts = pt.radius_components(xyz, 1.0).select("component").distinct().count()
    assert parts == (1 if gap < 1 else 2)
    assert sum(t.count() for name, t in rows if name.startswith("parts") or name == "frontier") < 200_000
