"""Bootstrap intervals against plain versions, for any number of partitions."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import statistics as st

ROUNDS = 300


def values(n=5000):
    r = random.Random(3)
    return [(i, r.gauss(2.0, 3.0) * 10 ** r.randrange(-2, 3)) for i in range(n)]


def interval(means):
    s = sorted(means)
    return s[int(0.025 * (len(s) - 1))], s[int(0.975 * (len(s) - 1))]


def plain_bits(seed, r):
    x = (seed + r * st.GOLDEN) % 2**32
    x = (x ^ x >> 16) * st.MIX_1 % 2**32
    x = (x ^ x >> 15) * st.MIX_2 % 2**32
    return x ^ x >> 16


def test_poisson_rounds(spark):
    rows = values(400)
    seeds = [int(hashlib.md5(f"{i}:7".encode()).hexdigest()[:8], 16) for i, _ in rows]
    cuts = st.poisson_cuts()
    means = []
    for r in range(60):
        weights = [sum(plain_bits(s, r) >= c for c in cuts) for s in seeds]
        means.append(sum(w * v for w, (_, v) in zip(weights, rows, strict=True)) / sum(weights))
    got = st.bootstrap_ci(spark.createDataFrame(rows, "id long, v double"), "id", "v", 60, 7).first()
    assert tuple(got) == pytest.approx(interval(means), rel=1e-9)


@pytest.mark.parametrize("method", [st.bootstrap_ci, st.bootstrap_ci_multinomial])
def test_any_partitioning_and_width(spark, method):
    """The same interval to the last bit for 1, 7 and 40 partitions; about 1.96 standard errors on both sides."""
    rows = values()
    df = spark.createDataFrame([*rows, (10**6, None)], "id long, v double")
    got = {tuple(method(df.repartition(k, F.rand(k)), "id", "v", 1000, 5).first()) for k in (1, 7, 40)}
    assert len(got) == 1
    v = np.array([x for _, x in rows])
    low, high = got.pop()
    error = v.std() / np.sqrt(len(v))
    assert low == pytest.approx(v.mean() - 1.96 * error, abs=0.3 * error)
    assert high == pytest.approx(v.mean() + 1.96 * error, abs=0.3 * error)


def test_multinomial_equals_plain_version(spark):
    rows = [(i, round(v * 1024) / 1024) for i, v in values(1000)]  # whole numbers of few bits: no rounding
    n, leaves = len(rows), -(-len(rows) // 64)
    v = np.array([x for _, x in rows])
    totals = np.zeros(ROUNDS)
    drawn = np.zeros(ROUNDS, int)
    for leaf in range(leaves):
        counts = st.leaf_draws(leaf, n, ROUNDS, 9, 64)
        own = v[leaf * 64 : leaf * 64 + 64]
        picked = np.random.Generator(np.random.Philox(key=[9, (1 << 63) | leaf])).integers(0, len(own), int(counts.sum()))
        for r, part in enumerate(np.split(own[picked], np.cumsum(counts)[:-1])):
            totals[r] += part.sum()
        drawn += counts
    assert set(drawn.tolist()) == {n}  # n of n rows in every round
    got = st.bootstrap_ci_multinomial(spark.createDataFrame(rows, "id long, v double").repartition(5), "id", "v", ROUNDS, 9, width=64).first()
    assert tuple(got) == pytest.approx(interval(totals / n), rel=1e-9)


@pytest.mark.parametrize("method", [st.bootstrap_ci, st.bootstrap_ci_multinomial])
def test_few_rows(spark, method):
    df = spark.createDataFrame([(1, 2.5)], "id long, v double")
    low, high = method(df, "id", "v", 50, 1).first()
    assert high == 2.5 and low in (0.0, 2.5)  # a Poisson round may be empty
    assert method(df.limit(0), "id", "v", 50, 1).first()[0] is None
