import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ngram_model as m
from tallyloom.operators import ngram_score as sc

TOY0 = ["a a b a", "b a a b"]
TOY1 = ["a a b b b b b b b", "c"]


def corpus(spark, lines):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "line_no int, line string")
    from tallyloom.functions.tokens import tokens_of

    return df.select("line_no", tokens_of(F.col("line")).alias("tokens"))


def model(spark, lines, order=3):
    lm = m.train(corpus(spark, lines), order, fallback=m.FALLBACK_DISCOUNTS)
    return {r["words"]: r for r in lm.collect()}


def test_toy0_golden(spark):
    lm = model(spark, TOY0)
    assert len(lm) == 19
    want = {
        "<unk>": (-0.90309, 0), "<s>": (0, -0.30103), "a": (-0.46943438, -0.30103),
        "</s>": (-0.5720968, 0), "<s> a": (-0.37712017, -0.30103), "a </s>": (-0.58682007, 0),
        "a a b": (-0.20102891, 0), "b a </s>": (-0.42082912, 0),
    }
    for w, (p, b) in want.items():
        assert lm[w]["prob"] == pytest.approx(p, abs=1e-6)
        assert lm[w]["backoff"] == pytest.approx(b, abs=1e-4)


def test_toy1_golden(spark):
    lm = model(spark, TOY1)
    assert lm["<unk>"]["prob"] == pytest.approx(-1, abs=1e-6)
    assert lm["b b"]["prob"] == pytest.approx(-0.3422159, abs=1e-6)
    assert lm["b b"]["backoff"] == pytest.approx(-0.47712123, abs=1e-4)
    assert lm["b b </s>"]["prob"] == pytest.approx(-0.7462621, abs=1e-6)


def test_counts(spark):
    lines = ["looking on a little more loin", "on a little more loin", "on foo little more loin", "bar", ""]
    got = {r["words"]: r["raw"] for r in m.ngram_counts(corpus(spark, lines), 3).collect()}
    assert got["on a little"] == 2 and got["a little more"] == 2 and got["little more loin"] == 3
    assert got["more loin </s>"] == 3 and got["<s> <s> on"] == 2 and got["<s> <s> </s>"] == 1
    assert len(got) == 15
    totals = m.corpus_totals(corpus(spark, lines)).first()
    assert (totals["tokens"], totals["types"]) == (17, 11)


def test_bad_discount_raises(spark):
    with pytest.raises(Exception, match="bad discount"):
        m.train(corpus(spark, TOY0), 2)


def test_probabilities_sum_to_one_and_q_scores(spark):
    lines = TOY0 + TOY1
    sents = corpus(spark, lines)
    lm = m.train(sents, 3, fallback=m.FALLBACK_DISCOUNTS)
    vocab = [r[0] for r in lm.filter("order=1 and words <> '<s>'").select("words").collect()]
    for ctx in ["a", "b b", "<s> a", "c", ""]:
        win = spark.createDataFrame([((ctx + " " + w).strip(),) for w in vocab], "words string")
        scored = sc.score_windows(win, lm, 3).join(win, "words", "left_semi")
        assert sum(10 ** r["prob"] for r in scored.collect()) == pytest.approx(1.0, abs=1e-9)
    # the collapsed values give the same sentence totals when every n-gram is present
    q = {r["words"]: r["q"] for r in m.collapse_q(lm, 3).collect()}
    toks = "<s> a a b a </s>".split()
    total = sum(q[" ".join(toks[max(0, i - 2): i + 1])] for i in range(1, len(toks)))
    got = {r["line_no"]: r["score"] for r in sc.score_sentences(sc.score_tokens(sents, lm, 3, ["line_no"]), ["line_no"]).collect()}
    # the start mark's own backoff was divided out of the first step
    assert total + q["<s>"] == pytest.approx(got[0], abs=1e-9)


def test_prune_and_vocabulary(spark):
    sents = corpus(spark, TOY0)
    counts = m.adjusted_counts(m.ngram_counts(sents, 3), 3)
    pruned = {(r["order"], r["words"]) for r in m.prune(counts, [0, 0, 1]).collect() if r["pruned"]}
    raw = {(r["order"], r["words"]): r["raw"] for r in counts.collect()}
    assert pruned == {k for k, v in raw.items() if k[0] == 3 and v <= 1}
    lim = m.limit_vocabulary(counts, spark.createDataFrame([("a",)], "word string"))
    marked = {r["words"] for r in lim.collect() if r["pruned"]}
    assert marked == {w for (_, w) in raw if "b" in w.split()}
    small = m.smooth(m.prune(counts, [0, 0, 1]), 3, m.FALLBACK_DISCOUNTS)
    assert small.filter("order = 3").count() == sum(1 for k, v in raw.items() if k[0] == 3 and v > 1)


def test_unknown_mapping(spark):
    sents = corpus(spark, ["a x a", "x b"])
    out = m.map_to_vocabulary(sents, spark.createDataFrame([("a",), ("b",)], "word string"), ["line_no"])
    assert {r["line_no"]: r["tokens"] for r in out.collect()} == {0: ["a", "<unk>", "a"], 1: ["<unk>", "b"]}


def test_choose_completion(spark):
    df = spark.createDataFrame(
        [(1, 0, 0, 2, 9.0), (1, 0, 1, 2, 1.0), (1, 0, 2, 2, 1.0), (1, 1, 0, 2, 0.0), (1, 1, 1, 2, 1.5)],
        "item int, option int, pos int, ctx_len int, loss double",
    )
    assert [tuple(r) for r in sc.choose_completion(df).collect()] == [(1, 1, 0)]


def test_a_shared_model_leaves_no_tables_of_its_steps(spark, tmp_path):
    """Of the steps below a written model only what other queries share stays, and the discounted rows are not written at all."""
    import os

    from tallyloom.plans import ngram_queries, registry
    from tallyloom.session import checkpoint_root

    spark.createDataFrame([(0, "a b a c\nb a"), (1, "c a b"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    checkpoint_root(spark)
    folder = os.path.join(checkpoint_root(spark), "tables")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    model = ngram_queries.doc_lm(spark, str(tmp_path))
    left = sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before)
    assert left == ["contexts", "counts1", "counts2", "counts3", "discounts", "lm"]
    assert model.count() == ngram_queries.doc_counts(spark, str(tmp_path)).count()
    registry.forget_shared()
