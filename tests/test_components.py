"""Connected components against a plain union-find, by broadcast and by shuffle."""

from __future__ import annotations

import random

import pytest

from tallyloom.operators import components


def brute(links):
    least = {x: x for pair in links for x in pair}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        least[y] = x
    return {x: root(x) for a, b in links for x in (a, b) if any(p != q for p, q in links if x in (p, q))}


def cases():
    r = random.Random(1)
    yield []
    yield [(5, 5)]
    yield [(1, i) for i in range(2, 30)]  # a star already
    yield [(i, i + 1) for i in range(40)]  # a path
    yield [((i * 17) % 41, ((i + 1) * 17) % 41) for i in range(30)]  # a path of mixed ids
    yield [(r.randrange(60), r.randrange(60)) for _ in range(45)]


@pytest.mark.parametrize("limit", [200_000, 0])
@pytest.mark.parametrize("links", list(cases()))
def test_components(spark, monkeypatch, links, limit):
    monkeypatch.setattr(components, "BROADCAST", limit)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == brute(links) and len(got) == len(brute(links))
