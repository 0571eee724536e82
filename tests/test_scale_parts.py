"""Steps on a model run part by part, leave nothing beside their results and give the rows of one part."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.tokens import SLICES, context_of, context_slice, slice_of, suffix_of, tokens_of
from tallyloom.operators import ngram_mix as mix
from tallyloom.operators import ngram_model as nm
from tallyloom.operators import ngram_score as ns
from tallyloom.session import checkpoint_root, materialise
from tallyloom.sources import arpa

LINES = ["a b a c d", "b a e f a b", "c a b g", "h a b a c", "d e f", "", "a"]
OTHER = ["a c d b", "e f a x", "b a c"]


def corpus(spark, lines):
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
    return rows.select("line_no", tokens_of(F.col("line")).alias("tokens"))


def values(df):
    return {tuple(x for x in r if not isinstance(x, float)): [x for x in r if isinstance(x, float)] for r in df.collect()}


def tables(spark):
    folder = os.path.join(checkpoint_root(spark), "tables")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def like(got, want):
    assert got.keys() == want.keys()
    for key, numbers in want.items():
        assert got[key] == pytest.approx(numbers, abs=1e-9), key


def test_n_grams_share_the_slice_of_their_context_and_suffix(spark):
    w = F.col("w")
    rows = spark.createDataFrame([("a",), ("a b",), ("a b c",), ("x b c",), ("q a b c",)], "w string")
    got = {r["w"]: r for r in rows.select("w", slice_of(w).alias("s"), context_slice(context_of(w)).alias("c"), slice_of(suffix_of(w)).alias("b")).collect()}
    assert got["a"]["s"] == 0 and all(r["s"] == r["c"] for r in got.values())
    assert got["a b c"]["s"] == got["x b c"]["s"] == got["a b c"]["b"] and got["q a b c"]["s"] == got["q a b c"]["b"]


def test_parts_hold_every_slice_once(spark, monkeypatch):
    monkeypatch.setattr(nm, "PART_ROWS", 10)
    rows = spark.range(SLICES).select(F.col("id").cast("int").alias("slice"))
    conditions = nm.parts({0: 25, 3: 9, 5: 1})
    assert len(conditions) == 4
    assert sorted(r["slice"] for c in conditions for r in rows.filter(c).collect()) == list(range(SLICES))
    assert len(nm.parts({0: 10})) == 1 and len(nm.parts({s: 1000 for s in range(SLICES)})) == SLICES


@pytest.fixture(scope="module")
def models(spark):
    before = tables(spark)
    found = [nm.train(corpus(spark, x), 3, nm.FALLBACK_DISCOUNTS) for x in (LINES, OTHER)]
    assert sorted(name.rsplit("-", 1)[0] for name in tables(spark) - before) == ["lm", "lm"]
    return found


def test_parts_give_the_rows_of_the_whole(spark, monkeypatch, models):
    asked = corpus(spark, ["a b a z", "c d e"])

    def steps(lm):
        yield nm.collapse_q(lm, 3)
        yield ns.score_groups(asked, lm, 3, ["line_no"])
        yield mix.merge_probabilities([lm, models[1]], [0.6, 0.4], 3)
        yield mix.normalize_mixture([lm, models[1]], [0.6, 0.4], 3)

    whole = [values(df) for df in steps(models[0])]
    found, counted = [], nm.parts
    for module in (nm, ns, mix):
        monkeypatch.setattr(module, "parts", lambda sizes: found.append(len(counted(sizes))) or counted(sizes))
    monkeypatch.setattr(nm, "PART_ROWS", 18)
    lm = nm.train(corpus(spark, LINES), 3, nm.FALLBACK_DISCOUNTS)
    like(values(lm), values(models[0]))
    for got, want in zip(steps(lm), whole, strict=True):
        like(values(got), want)
    assert max(found) > 1


def test_weights_are_tuned_alike_in_parts(spark, monkeypatch, models):
    want = mix.tune_weights(models, corpus(spark, ["a b a c", "e f a"]), 3, rounds=1)
    monkeypatch.setattr(nm, "PART_ROWS", 24)
    got = mix.tune_weights(models, corpus(spark, ["a b a c", "e f a"]), 3, rounds=1)
    assert got[1]["weights"] == pytest.approx(want[1]["weights"], abs=1e-9)
    assert got[0]["perplexity"] == pytest.approx(want[0]["perplexity"], abs=1e-9)


def test_ranges_of_a_file_are_one_file(spark, monkeypatch, tmp_path, models):
    lm = models[0]
    text = {}
    for rows in (arpa.SORT_ROWS, 14):
        monkeypatch.setattr(arpa, "SORT_ROWS", rows)
        path = str(tmp_path / str(rows))
        arpa.write_arpa(lm, path, 3)
        text[rows] = "".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*")))
        assert arpa.read_arpa(spark, path).count() == lm.count()
    assert len(set(text.values())) == 1 and len(text) == 2
    assert os.listdir(tmp_path) and not glob.glob(f"{tmp_path}/*.[0-9]*")


def test_sorted_tables_hold_the_same_rows_in_less_room(spark):
    rows = spark.range(20000).select(F.concat(F.lit("word "), F.md5((F.col("id") % 500).cast("string")), F.lit(" "), F.col("id").cast("string")).alias("words"))
    size = lambda df: sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles())
    plain, short = materialise(rows, "plain"), materialise(rows, "short", sort=["words"])
    assert sorted(plain.collect()) == sorted(short.collect()) and size(short) < size(plain) / 2
