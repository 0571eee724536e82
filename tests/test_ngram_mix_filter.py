import itertools

import numpy as np
import pytest

from tallyloom.operators import ngram_filter as nf
from tallyloom.operators import ngram_mix as mix
from tallyloom.operators import ngram_model as m
from tallyloom.operators import ngram_score as sc
from tests.test_ngram_model import TOY0, TOY1, corpus


@pytest.fixture(scope="module")
def models(spark):
    from tallyloom.session import materialise

    return [materialise(m.train(corpus(spark, t), 3, m.FALLBACK_DISCOUNTS), "toy") for t in (TOY0, TOY1)]


def tables(models):
    return [{r["words"]: (r["prob"], r["backoff"]) for r in lm.collect()} for lm in models]


def logp(t, ctx, w):
    """Brute-force backoff score of w after the words of ctx."""
    words = [x if x in t else "<unk>" for x in [*ctx, w]]
    key = " ".join(words)
    if key in t:
        return t[key][0]
    if len(words) == 1:
        return t["<unk>"][0]
    return t.get(" ".join(words[:-1]), (0, 0))[1] + logp(t, words[1:-1], words[-1])


def test_normalized_mixture_is_the_definition(spark, models):
    lam = [0.6, 0.4]
    ts = tables(models)
    joint = {r["words"]: (r["prob"], r["backoff"]) for r in mix.normalize_mixture(models, lam, 3).collect()}
    vocab = sorted({w for t in ts for w in t if " " not in w} - {"<s>"})
    contexts = [(), ("a",), ("b",), ("<s>",), ("a", "a"), ("b", "b"), ("<s>", "a"), ("<s>", "c"), ("c",), ("b", "a")]
    for ctx in contexts:
        raw = {w: sum(l * logp(t, ctx, w) for l, t in zip(lam, ts)) for w in vocab}
        z = np.log10(sum(10 ** v for v in raw.values()))
        for w in vocab:
            assert logp(joint, ctx, w) == pytest.approx(raw[w] - z, abs=1e-9), (ctx, w)


def test_merge(spark, models):
    vocab = {r["word"]: (r["in_0"], r["in_1"]) for r in mix.merge_vocab(models).collect()}
    assert vocab["c"] == (False, True) and vocab["a"] == (True, True)
    merged = {r["words"]: r for r in mix.merge_probabilities(models, [0.6, 0.4], 3).collect()}
    ts = tables(models)
    r = merged["b a </s>"]
    assert r["from_0"] == 2 and r["from_1"] == 0
    assert r["prob"] == pytest.approx(0.6 * ts[0]["b a </s>"][0] + 0.4 * ts[1]["</s>"][0])
    assert r["lower"] == pytest.approx(0.6 * ts[0]["a </s>"][0] + 0.4 * ts[1]["</s>"][0])


def brute_tuning(ts, lines, order, rounds):
    """Newton steps by summing over the whole vocabulary for every token."""
    n = len(ts)
    vocab = sorted({w for t in ts for w in t if " " not in w} - {"<s>"})
    inst = []
    for line in lines:
        seq = ["<s>", *line.split(), "</s>"]
        inst += [(tuple(seq[max(0, i - order + 1): i]), seq[i]) for i in range(1, len(seq))]
    logs = {c: {v: np.log(10) * np.array([logp(t, c, v) for t in ts]) for v in {*vocab, *(w for d, w in inst if d == c)}} for c, _ in inst}
    w, want = np.full(n, 1 / n), []
    for _ in range(rounds):
        g, h, obj = np.zeros(n), np.zeros((n, n)), 0.0
        for ctx, word in inst:
            lp = logs[ctx]
            un = {v: np.exp(w @ lp[v]) for v in vocab}
            z = sum(un.values())
            mean = sum(un[v] / z * lp[v] for v in vocab)
            g += mean - lp[word]
            h += sum(un[v] / z * np.outer(lp[v], lp[v]) for v in vocab) - np.outer(mean, mean)
            obj += np.log(z) - w @ lp[word]
        want.append((w.copy(), np.exp(obj / len(inst))))
        w = w - 0.7 * np.linalg.solve(h, g)
    return want, w


def check_tuning(spark, models, lines, order, rounds):
    want, last = brute_tuning(tables(models), lines, order, rounds)
    got = mix.tune_weights(models, corpus(spark, lines), order, rounds=rounds)
    for (ww, ppl), row in zip(want, got):
        assert row["weights"] == pytest.approx(list(ww), abs=1e-9)
        assert row["perplexity"] == pytest.approx(ppl, abs=1e-9)
    assert got[-1]["weights"] == pytest.approx(list(last), abs=1e-9)


def test_tuning_follows_brute_force(spark, models):
    check_tuning(spark, models, ["a b c", "b b a"], 3, 3)


def test_tuning_three_models_of_order_four(spark):
    """Contexts that share suffixes, n-grams that only one model has, words that none knows."""
    import random

    from tallyloom.session import materialise

    r = random.Random(5)
    text = lambda letters, k: [" ".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(k)]
    three = [materialise(m.train(corpus(spark, text(x, 25)), 4, m.FALLBACK_DISCOUNTS), "four") for x in ("aab", "abcc", "bcd")]
    check_tuning(spark, three, [*text("abcd", 8), "a q b c a"], 4, 2)


def test_partition_sums_are_whole(spark, models):
    """The sums of a node are those over the vocabulary, and no table grows with contexts times followers."""
    ts = tables(models)
    vocab = sorted({w for t in ts for w in t if " " not in w} - {"<s>"})
    uni, nodes, followers, _ = mix.tuning_tree(models, corpus(spark, ["a b c", "b b a", "c c c"]), 3)
    assert followers.count() <= len({w for t in ts for w in t if " " in w})
    lam = [0.7, 0.4]
    for level in mix.partition_sums(uni, nodes, followers, lam, 3).values():
        for row in level.collect():
            logs = [np.log(10) * np.array([logp(t, tuple(row["ctx"].split(" ")), v) for t in ts]) for v in vocab]
            assert row["s"] == pytest.approx(sum(np.exp(np.dot(lam, x)) for x in logs), rel=1e-12)
            assert row["s_0_1"] == pytest.approx(sum(np.exp(np.dot(lam, x)) * x[0] * x[1] for x in logs), rel=1e-12)


def ngram_df(spark, items):
    return spark.createDataFrame([(x,) for x in items], "words string")


def got(df):
    return {r["words"] for r in df.collect()}


def test_word_filters(spark):
    grams = ngram_df(spark, ["a b", "a c", "<s> a", "b c", "c d", "<s>", "a a", "z a"])
    sv = spark.createDataFrame(
        [(0, "a"), (0, "b"), (1, "a"), (1, "c"), (100, "c"), (100, "d"), (100, "b")], "sent_id bigint, word string"
    )
    vocab = sv.select("word").distinct()
    assert got(nf.filter_single(grams, vocab)) == {"a b", "a c", "<s> a", "b c", "c d", "<s>", "a a"}
    assert got(nf.filter_union(grams, sv)) == {"a b", "a c", "<s> a", "b c", "c d", "<s>", "a a"}
    pairs = {tuple(r) for r in nf.filter_multiple(grams, sv).collect()}
    assert pairs == {
        (0, "a b"), (1, "a c"), (0, "<s> a"), (1, "<s> a"), (100, "b c"), (100, "c d"), (0, "a a"), (1, "a a"), (None, "<s>"),
    }
    assert got(nf.filter_context(ngram_df(spark, ["a z", "z a", "q"]), vocab)) == {"a z", "q"}


def brute_phrase(gram, sents):
    words = gram.split()
    if words[0].startswith("<") and words[0].endswith(">"):
        words = words[1:]
    if "</s>" in words:
        words = words[: words.index("</s>")]
    if not words:
        return None
    n = len(words)
    out = set()
    for sid, phrases in sents.items():
        ps = [p.split() for p in phrases]
        sub = lambda seg: any(p[i:i + len(seg)] == seg for p in ps for i in range(len(p)))
        for cuts in itertools.product([0, 1], repeat=n - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
            segs = [words[x:y] for x, y in zip(at, at[1:])]
            if len(segs) == 1:
                ok = sub(segs[0])
            else:
                ok = any(p[-len(segs[0]):] == segs[0] for p in ps)
                ok = ok and all(any(p == s for p in ps) for s in segs[1:-1])
                ok = ok and any(p[: len(segs[-1])] == segs[-1] for p in ps)
            if ok:
                out.add(sid)
    return out


def test_phrase_filter_against_brute_force(spark):
    sents = {0: ["a b c", "d"], 1: ["b", "c a", "a"], 70: ["d d", "a c b a"]}
    phrases = spark.createDataFrame([(s, p) for s, ps in sents.items() for p in ps], "sent_id bigint, phrase string")
    grams = [" ".join(x) for k in (1, 2, 3, 4) for x in itertools.product("abcd", repeat=k)] + ["<s> a b", "b </s>", "<s> </s>", "<s> d d d"]
    want = {g: brute_phrase(g, sents) for g in grams}
    pairs = {(s, g) for g, ss in want.items() if ss for s in ss} | {(None, g) for g, ss in want.items() if ss is None}
    df = ngram_df(spark, grams)
    assert {tuple(r) for r in nf.filter_phrase(df, phrases, "multiple").collect()} == pairs
    assert got(nf.filter_phrase(df, phrases, "union")) == {g for _, g in pairs}


def test_phrase_table(spark):
    s = spark.createDataFrame([(0, ["x", "y", "z"]), (1, [])], "sent_id bigint, tokens array<string>")
    t = spark.createDataFrame([("x y", "u v"), ("y z", "w"), ("z x", "no")], "source string, target string")
    assert {tuple(r) for r in nf.phrase_table_vocab(s, t).collect()} == {(0, w) for w in "xyzuvw"}


def test_scores_match_brute_force(spark, models):
    lines = ["a b q a", "b b b b", "", "c a"]
    t = tables(models)[1]
    toks = sc.score_tokens(corpus(spark, lines), models[1], 3, ["line_no"]).collect()
    assert len(toks) == sum(len(l.split()) + 1 for l in lines)
    for r in toks:
        seq = ["<s>", *lines[r["line_no"]].split(), "</s>"]
        i = r["pos"] + 1
        assert seq[i] == r["word"]
        assert r["prob"] == pytest.approx(logp(t, seq[max(0, i - 2): i], seq[i]), abs=1e-9)
        assert r["oov"] == (seq[i] == "q")
    total = sc.corpus_perplexity(corpus(spark, lines), models[1], 3).first()
    assert total["tokens"] == len(toks) and total["oovs"] == 1
    assert total["total"] == pytest.approx(sum(r["prob"] for r in toks))


def test_ngrams_outside_the_vocabulary_are_gone_before_they_are_cut(spark, monkeypatch):
    """Only n-grams whose words all stand in a phrase are cut into segments, and none is moved to be looked up."""
    grams = spark.createDataFrame([("a b c", 1), ("x a b", 1), ("a b x", 2), ("<s> a b", 3), ("b c </s>", 1), ("<s> </s>", 1)], "words string, raw long")
    phrases = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, "b")], "sent_id long, phrase string")
    cut, before = [], nf._segmentations
    monkeypatch.setattr(nf, "_segmentations", lambda g: cut.append(sorted(r.words for r in g.collect())) or before(g))
    got = sorted(tuple(r) for r in nf.filter_phrase(grams, phrases, "union", 3).collect())
    assert got == [("<s> </s>", 1), ("<s> a b", 3), ("a b c", 1), ("b c </s>", 1)]
    assert cut == [["<s> </s>", "<s> a b", "a b c", "b c </s>"]]
    vocab = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "word string")
    known = nf.filter_single(grams.unionByName(spark.createDataFrame([(None, 9), ("a b c", 4)], "words string, raw long")), vocab)
    assert "hashpartitioning(words" not in known._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.words or "", r.raw) for r in known.collect()) == [("", 9), ("<s> </s>", 1), ("<s> a b", 3), ("a b c", 1), ("a b c", 4), ("b c </s>", 1)]
