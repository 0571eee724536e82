"""Character labels move texts whole and sort inside the row."""

import random

from tallyloom.operators import prep


def plain(texts, before_only):
    marks = sorted((i, c) for t in texts for i, c in enumerate(t))
    found, seen = [], {}
    for i, c in marks:
        n = seen.get(c, 0) if before_only else sum(x == c for _, x in marks) - 1
        seen[c] = seen.get(c, 0) + 1
        found.append((i, min(2, n)))
    return "".join(str(d) for _, d in sorted(found))


def test_char_labels_against_plain(spark):
    draw = random.Random(3)
    rows = [(i % 25 if i else None, "".join(draw.choice("ab é王\n𝄞") for _ in range(i % 9))) for i in range(40)] + [(50, None), (51, "")]
    df = spark.createDataFrame(rows, "k int, t string")
    for before_only in (True, False):
        made = prep.char_occurrence_labels(df, ["k"], "t", before_only)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange") <= 1
        texts = {}
        for k, t in rows:
            texts.setdefault(k, []).append(t or "")
        want = {k: plain(ts, before_only) for k, ts in texts.items() if any(ts)}
        assert {r["k"]: r["labels"] for r in made.collect()} == want
