"""Draws are cut by their number."""

import hashlib
import random

from tallyloom.operators import statistics as st


def test_exact_draws_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(st, "DRAWS", 500)
    spread = []
    made = type(spark).range
    monkeypatch.setattr(type(spark), "range", lambda self, *a, **k: spread.append(made(self, *a, **k)) or spread[-1])
    draw = random.Random(5)
    values = [draw.random() for _ in range(100)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v double").coalesce(1)
    ci = st.bootstrap_ci_exact(df, "k", "v", 40, 9)
    assert "SortMergeJoin" not in ci._jdf.queryExecution().executedPlan().toString()
    low, high = ci.first()
    assert [x.rdd.getNumPartitions() for x in spread] == [8]  # 4,000 draws
    number = lambda i, r: int(hashlib.md5(f"{i}:{r}:9".encode()).hexdigest()[:8], 16)
    means = sorted(sum(values[number(i, r) % 100] for i in range(1, 101)) / 100 for r in range(40))
    assert abs(low - means[int((1 - 0.95) / 2 * 39)]) < 1e-9 and abs(high - means[int((1 - (1 - 0.95) / 2) * 39)]) < 1e-9


def test_exact_draws_of_no_rows(spark):
    assert tuple(st.bootstrap_ci_exact(spark.createDataFrame([], "k int, v double"), "k", "v", 5).first()) == (None, None)
