import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import minhash as mh
from tallyloom.functions.ordering import rank_by_hash, rank_by_order
from tallyloom.functions.quantiles import exact_quantiles
from tallyloom.functions.stable import stable_hash
from tallyloom.operators import mixture as mx
from tallyloom.operators import near_dup as nd
from tallyloom.operators import prep
from tallyloom.operators.components import connected_components


def union_find(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_near_duplicates_equal_brute_force(spark):
    """Copies, near copies in chains, and buckets whose least id is not a match."""
    rng = random.Random(5)
    sigs = []
    for base in range(6):
        seed = [rng.randrange(10**6) for _ in range(128)]
        sigs += [list(seed)] * 5
        last = list(seed)
        for _ in range(12):
            last = list(last)
            for p in rng.sample(range(128), rng.choice([2, 5, 6, 7, 9])):
                last[p] = rng.randrange(10**6)
            sigs.append(last)
        far = list(seed)
        for p in range(64, 128):
            far[p] = rng.randrange(10**6)
        for _ in range(4):
            far = list(far)
            for p in rng.sample(range(64, 128), 6):
                far[p] = rng.randrange(10**6)
            sigs.append(far)
    rng.shuffle(sigs)
    edges = [(i, j) for i, j in itertools.combinations(range(len(sigs)), 2) if sum(x == y for x, y in zip(sigs[i], sigs[j])) >= 122]
    want = union_find(len(sigs), edges)
    df = spark.createDataFrame(list(enumerate(sigs)), "doc_id bigint, sig array<int>")
    got = {r["id"]: r["group_id"] for r in nd.near_duplicate_groups(nd.near_duplicate_links(df, "doc_id")).collect()}
    for i, g in enumerate(want):
        assert got.get(i, i) == g
    with pytest.raises(ValueError):
        nd.near_duplicate_links(df, "doc_id", threshold=0.8)


def test_hot_group_of_copies_gives_one_link_each(spark):
    sig = F.array(*[F.lit(i) for i in range(128)])
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, sig).otherwise(F.transform(sig, lambda x: (x + F.col("id") * 1000).cast("int"))).alias("sig"))
    assert nd.near_duplicate_links(df, "doc_id").count() == 999


def test_template_pages_give_linear_pairs(spark, monkeypatch):
    """Pages that share half their places, so four whole bands, and differ in the others; some have a near copy."""
    rng = np.random.default_rng(4)
    template = rng.integers(0, 10**6, 128)
    sigs = rng.integers(0, 10**6, (2000, 128))
    sigs[:, :64] = template[:64]
    for i in range(100):  # near copies of earlier pages: 5 to 7 places differ, anywhere
        sigs[1900 + i] = sigs[i * 3]
        sigs[1900 + i, rng.choice(128, 5 + i % 3, replace=False)] += 1
    met = []
    scored = nd._scored
    monkeypatch.setattr(nd, "_scored", lambda pairs, reps: met.append(pairs) or scored(pairs, reps))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(sigs)], "doc_id bigint, sig array<int>")
    got = {(r.a, r.b) for r in nd.near_duplicate_links(df, "doc_id").collect()}
    same = sum((sigs[:, None, k] == sigs[None, :, k]).astype(np.uint8) for k in range(128))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(same >= 122)) if a > b}
    assert got == want and len(want) > 60
    assert sum(p.count() for p in met) < 5 * len(sigs)


def test_contaminated(spark):
    base = list(range(128))
    near = [*base[:-6], *[900 + i for i in range(6)]]
    far = [*base[:-7], *[900 + i for i in range(7)]]
    t = spark.createDataFrame([(1, base), (2, near), (3, far), (4, near)], "id bigint, sig array<int>")
    b = spark.createDataFrame([(0, base)], "id bigint, sig array<int>")
    assert {r[0] for r in nd.contaminated(t, b).collect()} == {1, 2, 4}


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0])
def test_shared_shingles_equal_brute_force(spark, share):
    r = random.Random(2)
    items = {i: {f"s{r.randrange(40)}" for _ in range(r.randrange(1, 12))} | ({"hot"} if i % 3 else set()) for i in range(30)}
    items |= {100 + i: items[i] for i in range(5)}  # equal items
    docs = {i: {f"s{r.randrange(60)}" for _ in range(r.randrange(0, 40))} | {"hot"} for i in range(40)}
    table = lambda sets: spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "id bigint, shingle string")
    got = {tuple(x) for x in nd.shared_shingles(table(docs), table(items), share).collect()}
    want = {(d, i, len(a & b), len(b)) for d, a in docs.items() for i, b in items.items() if a & b and len(a & b) >= share * len(b)}
    assert got == want and want


def test_hot_shingle_makes_no_pairs(spark, monkeypatch):
    """A shingle of all 300 items and 10,000 documents: rows in proportion to documents."""
    rows = []
    written = nd.materialise
    monkeypatch.setattr(nd, "materialise", lambda df, name, by=(): rows.append(written(df, name, by)) or rows[-1])
    n = F.col("id")
    items = spark.range(300).select("id", F.explode(F.array(F.lit("hot"), *[F.concat(F.lit(f"i{k}-"), n) for k in range(9)])).alias("shingle"))
    docs = spark.range(10_000).select("id", F.explode(F.array(F.lit("hot"), F.concat(F.lit("d"), n), F.concat(F.lit("i0-"), n))).alias("shingle"))
    hits = nd.shared_shingles(docs, items, 0.2)
    assert hits.count() == 300 and {r.train_id == r.bench_id for r in hits.collect()} == {True}
    assert sum(t.count() for t in rows) < 3 * 10_000


def test_components_long_path(spark):
    n = 400
    links = [(i, i + 1) for i in range(n - 1)] + [(1000, 1001), (1001, 1000)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(n)} == {0} and got[1001] == 1000


def test_signatures_by_rows_equal_signatures_by_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x")], "id int, t string").select("id", F.split("t", " ").alias("toks"))
    one = {r["id"]: r["sig"] for r in mh.minhash_signatures(docs, "id", "toks", 2).collect()}
    rows = mh.shingled(docs, ["id"], "toks", 2).select("id", F.explode("__h").alias("h"))
    assert one == {r["id"]: r["sig"] for r in mh.minhash_of_rows(rows, "id", "h").collect()}


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_ranks_do_not_depend_on_partitions(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("g"), (F.col("id") % 5 + 1).alias("w"))
        ranked = rank_by_order(df, ["g"], [F.desc("id")], rank="r", amount="w", running="s", total="t")
        h = rank_by_hash(df.withColumn("h", stable_hash(F.col("id"))), ["g"], "h", ["id"], rank="r2")
        rows = ranked.join(h.select("id", "r2", "h"), "id").collect()
        for g in {r["g"] for r in rows}:
            own = sorted((r for r in rows if r["g"] == g), key=lambda r: -r["id"])
            total = 0
            for k, r in enumerate(own, 1):
                total += r["w"]
                assert (r["r"], r["s"], r["t"]) == (k, total, len(own))
            assert [r["r2"] for r in sorted(own, key=lambda r: (r["h"], r["id"]))] == list(range(1, len(own) + 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    a, b = rng.lognormal(0, 3, 5001), np.round(rng.normal(0, 1, 5001), 1)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    qs = [0.0, 0.01, 0.35, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, qs)
    assert got["a"] == pytest.approx(list(np.quantile(a, qs)), rel=1e-12)
    assert got["b"] == pytest.approx(list(np.quantile(b, qs)), rel=1e-12)


def test_budget_with_short_source(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(4)] + [("b", 10 + i, 10) for i in range(100)], "s string, id bigint, tok bigint")
    shares = spark.createDataFrame([("a", 40, 0.5), ("b", 1000, 0.5)], "s string, tokens bigint, share double")
    got = mx.sample_to_token_budget(df, shares, "s", "id", "tok", 200, 1).groupBy("s").agg(F.sum(F.col("copies") * F.col("tok"))).collect()
    assert {r[0]: r[1] for r in got} == {"a": 100, "b": 100}


def test_mixture_sums_and_lads(spark):
    stats = spark.createDataFrame([("x", 100, 10.0), ("y", 25, 100.0)], "source string, n bigint, p50 double")
    for m in (mx.mix_proportional(stats), mx.mix_temperature(stats, 0.5), mx.mix_lads(stats)):
        assert m.agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    w = {r["source"]: r["weight"] for r in mx.mix_lads(stats).collect()}
    assert w["y"] == pytest.approx(25**0.7 * np.log(101.0) ** 0.5)


def test_quarantine_keeps_every_row(spark):
    texts = ['{"k": 1}', '{"k": 1', '{"k": 1}}', "", '{"k": "}"}', '{"k":1}{"k":2}', "nope", '{"k": 1} x']
    good, bad = prep.quarantine_bad_json(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "k string")
    assert {r["t"] for r in good.collect()} == {'{"k": 1}', '{"k": "}"}'}
    assert {r["t"] for r in bad.collect()} == set(texts) - {'{"k": 1}', '{"k": "}"}'}
