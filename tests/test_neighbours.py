"""Values and runs across the slices of one order."""

from __future__ import annotations

import random

from tallyloom.functions.ordering import previous_by_order, runs_by_order


def rows():
    r = random.Random(1)
    out = [("hot", i, r.choice([1, 2, None]) if r.random() < 0.3 else 7) for i in range(3000)]  # many slices, long runs
    out += [(f"g{i % 40}", i, i // 160 % 2) for i in range(400)]
    out += [(None, i, 5) for i in range(20)] + [("one", 0, None)]
    r.shuffle(out)
    return out


def ordered():
    groups: dict = {}
    for g, o, v in rows():
        groups.setdefault(g, []).append((o, v))
    return {g: sorted(x, key=lambda t: t[0]) for g, x in groups.items()}


def test_previous(spark):
    df = spark.createDataFrame(rows(), "g string, o long, v long")
    got = {(r.g, r.o): r.p for r in previous_by_order(df, ["g"], ["o"], "v", "p").collect()}
    assert got == {(g, o): (x[i - 1][1] if i else None) for g, x in ordered().items() for i, (o, _) in enumerate(x)}


def test_runs(spark):
    df = spark.createDataFrame(rows(), "g string, o long, v long")
    got = {(r.g, r.o): r.run for r in runs_by_order(df, ["g"], ["o"], "v", "run").collect()}
    want = {}
    for g, x in ordered().items():
        run, before = 0, object()
        for o, v in x:
            run += v is None or v != before
            before = v
            want[g, o] = run
    assert got == want
    assert runs_by_order(df.limit(0), ["g"], ["o"], "v", "run").count() == 0
