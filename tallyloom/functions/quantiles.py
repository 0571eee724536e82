"""Exact quantiles of continuous columns by narrowing histograms.

An exact percentile aggregate keeps every distinct value in one buffer.  Here
each pass only counts values in a bounded number of buckets around the wanted
ranks, so neither a task nor the driver ever holds the column.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def exact_quantiles(df: DataFrame, columns: Mapping[str, Column], probs: Sequence[float]) -> dict[str, list[float]]:
    """Linearly interpolated quantiles per column; nulls and values that are not finite are left out."""
    names = list(columns)
    values = df.select(*[F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < math.inf), c.cast("double")).alias(f"c{i}") for i, c in enumerate(columns.values())])
    first = values.agg(
        *[f(f"c{i}").alias(f"{t}{i}") for i in range(len(names)) for t, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    wanted: dict[tuple[int, int], float | None] = {}
    spans: dict[tuple[int, int], tuple[float, float, int]] = {}
    for i in range(len(names)):
        n = first[f"n{i}"]
        if n == 0:
            continue
        for q in probs:
            for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1))):
                spans[i, k] = (first[f"lo{i}"], first[f"hi{i}"], 0)
                wanted[i, k] = None
    while True:
        for key, (lo, hi, _) in spans.items():
            if wanted[key] is None and lo == hi:
                wanted[key] = lo
        open_spans = sorted({(key[0], *spans[key]) for key in wanted if wanted[key] is None})
        if not open_spans:
            break
        cells = []
        for s, (i, lo, hi, _) in enumerate(open_spans):
            x = F.col(f"c{i}")
            # halves where the span itself is no finite number
            share = (x - lo) / (hi - lo) if hi - lo < math.inf else (x / 2 - lo / 2) / (hi / 2 - lo / 2)
            at = F.least(F.floor(share * BUCKETS).cast("int"), F.lit(BUCKETS - 1))
            cells.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(s).alias("s"), at.alias("b"), x.alias("x"))))
        counted = (
            values.select(F.explode(F.array_compact(F.array(*cells))).alias("v")).groupBy("v.s", "v.b")
            .agg(F.count(F.lit(1)).alias("n"), F.min("v.x").alias("lo"), F.max("v.x").alias("hi"))
            .collect()  # at most BUCKETS rows per open span
        )
        by_span: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["s"], r["b"])):
            by_span.setdefault(r["s"], []).append(r)
        where = {span: s for s, span in enumerate(open_spans)}
        for (i, k), value in list(wanted.items()):
            if value is not None:
                continue
            base = spans[i, k][2]
            for r in by_span[where[i, *spans[i, k]]]:
                if k < base + r["n"]:
                    spans[i, k] = (r["lo"], r["hi"], base)
                    break
                base += r["n"]
    out: dict[str, list[float]] = {}
    for i, name in enumerate(names):
        n = first[f"n{i}"]
        got = []
        for q in probs:
            if n == 0:
                got.append(math.nan)
                continue
            at = q * (n - 1)
            a, b = wanted[i, math.floor(at)], wanted[i, math.ceil(at)]
            got.append(a + (b - a) * (at - math.floor(at)))
        out[name] = got
    return out
