"""MinHash signatures take each shingle once, in one place."""

from pyspark.sql import functions as F

from tallyloom.functions import minhash as mh

TEXTS = [(1, ["a", "b", "c", "a", "b", "c"]), (2, ["x"]), (3, []), (4, None), (5, ["a", None, "c d", "", "é語"]), (6, [None]), (None, ["a", "b", "c"]), (1, ["z"] * 3000)]


def test_shingles_of_a_text_have_the_same_values_in_python(spark):
    docs = spark.createDataFrame(TEXTS, "id int, toks array<string>").filter("size(toks) > 0")
    for n in (1, 2, 5):
        for row in mh.shingled(docs, ["id", "toks"], "toks", n).collect():
            words = [None if t is None else t.encode() for t in row.toks]
            assert set(mh.token_hashes(words, n).tolist()) == set(row["__h"])


def test_signatures_are_the_minima_over_all_shingles(spark):
    docs = spark.createDataFrame(TEXTS, "id int, toks array<string>")
    signed = mh.minhash_signatures(docs, "id", "toks", 2)
    a, b = mh.coefficients(128)
    want = []
    for row in mh.shingled(docs.filter("size(toks) > 0"), ["id"], "toks", 2).collect():
        want.append((row["id"], [min((h * int(x) + int(y)) % mh.PRIME for h in row["__h"]) for x, y in zip(a, b)]))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r) for r in signed.collect()], key=key) == sorted(want, key=key)
    # no array of shingle strings is built below the workers
    assert "md5" not in signed._jdf.queryExecution().optimizedPlan().toString()
