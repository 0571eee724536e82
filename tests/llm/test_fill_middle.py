"""Fill-in-middle against a plain version, and exact restoring."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import fill_middle as fm
from tests.llm import cases
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def plain_version(doc_id, text, split=list):
    text = text or ""
    units = split(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    r = random.Random(4)
    out = [(d, t) for d, t, _ in cases.documents()]
    out += [(200 + i, "".join(r.choice("aé語🙂 \n<PSM>") for _ in range(r.randrange(0, 5000)))) for i in range(60)]
    out += [(300, "x <P> y"), (301, "<S>"), (302, "a<M>"), (303, "<<P"), (304, "<" * 40), (305, "P><S"), (306, "🙂"), (307, "語" * 400_000), (308, "\0\x01 a")]
    return out


@pytest.mark.parametrize("block", [fm.BLOCK, 7])
def test_equals_plain_version(spark, block):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("form", F.lit(1))
    made = fm.fill_in_middle(df, F.col("doc_id"), F.col("text"), ["doc_id"], block=block)
    got = made.withColumn("again", fm.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((cases.key((d, *plain_version(d, t), t or "")) for d, t in data))
    assert sorted(cases.key(r) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def word_units(text):
    return re.findall(r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)


def line_units(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


@pytest.mark.parametrize(("unit", "split"), [("word", word_units), ("line", line_units)])
def test_other_units(spark, unit, split):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = fm.fill_in_middle(df, F.col("doc_id"), F.col("text"), ["doc_id"], unit=unit).collect()
    assert sorted(cases.key(r) for r in got) == sorted(cases.key((d, *plain_version(d, t, split))) for d, t in data)


def test_fenwick_descends_to_the_block():
    r = np.random.default_rng(1)
    for size in (1, 2, 3, 7, 8, 9, 100):
        counts = r.integers(0, 4, (size, 2))
        tree = fm.Fenwick(counts)
        sums = np.concatenate([[[0, 0]], np.cumsum(counts, axis=0)])
        assert tree.totals() == sums[-1].tolist()
        for wanted in range(int(sums[-1][0]) + 2):
            at = int(np.searchsorted(sums[:, 0], wanted, "right")) - 1
            assert tree.descend(wanted) == (at, sums[at].tolist())


def test_empty_table_and_sql(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fm.fill_in_middle(empty, F.col("doc_id"), F.col("text"), ["doc_id"]).count() == 0
    ok, note = compare(spark, SF, fm.op11_fill_middle, fm.OP11_SQL)
    assert ok, note
