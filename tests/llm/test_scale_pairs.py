"""Sets that share many lists meet in few of them."""

from pyspark.sql import functions as F

from tallyloom.llm import setjoin

LISTS = 300


def banded(spark, met):
    """Three sets in the same lists, the third of them without those of odd number; ``met``: lists known before each."""
    rows = []
    for node in (1, 2, 3):
        keys = [k for k in range(LISTS) if node < 3 or k % 2 == 0]
        rows += [(k, 0, node, node, 5000, 10, [5000] + [0] * 63, keys[max(0, i - met) : i], 0) for i, k in enumerate(keys)]
    schema = "key long, band long, node long, component long, n int, lacks int, counts array<smallint>, met array<long>, own long"
    return spark.createDataFrame(rows, schema).withColumn("band", F.col("own"))


def test_a_pair_of_many_common_lists_meets_once(spark):
    every = setjoin._meet(banded(spark, 0), 80)
    first = setjoin._meet(banded(spark, setjoin.BEFORE), 80)
    assert every.count() == LISTS * 2
    assert sorted(map(tuple, first.collect())) == [(2, 5000, 1, 5000), (3, 5000, 1, 5000), (3, 5000, 2, 5000)]


def test_sets_with_many_common_lists_are_linked(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "FEW_PAIRS", 10**9)  # no more centres than the first
    monkeypatch.setattr(setjoin, "BEFORE", 2)
    words = [f"w{i}" for i in range(400)]
    other = [f"v{i}" for i in range(400)]
    texts = {5: words[:200] + other[:20], 7: other[:200], 9: other[:195] + words[300:305], 11: words[:210], 13: words[5:215], 17: other[3:203]}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in setjoin.set_components(docs, "doc_id", "text", 5, 80).collect()}
    assert got == {5: 5, 11: 5, 13: 5, 7: 7, 9: 7, 17: 7}
