"""Operators over documents against brute-force versions, edge rows included."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, lm_score, mixing, quality, repeats, setjoin, token_counts
from tests.llm import cases

SF = "/root/testdata/sf0.001"


def real(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# mixing sources


def mixed(rows, weights=(5, 2, 1), share=1.5, cap=2.0):
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(cases.words(t))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), set(names)
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if each * weight[s] > cap * sizes[s]}
        for s in over or open_:
            target[s] = cap * sizes[s] if over else each * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    return sizes, target


def test_mix_targets_and_takes(spark):
    rows = cases.documents()
    df = cases.frame(spark).select("doc_id", "text", "source", *[c for c in cases.CLASHES if c not in ("size", "target")])
    got, takes = mixing.mix(df, F.col("text"), F.col("source"), F.col("doc_id"), ["doc_id", "source"], block=64)
    out = mixing.taken(got, takes).collect()
    assert len(out) == len(rows)
    sizes, target = mixed(rows)
    per: dict = Counter()
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        per[r.source] += r.taken
    for s in sizes:
        assert abs(per[s] - target[s]) <= 0.5
    # the schedule: each slot one block of one source, and every prefix near the shares
    slots = takes.join(got.select("row_id", F.coalesce("source", F.lit("none")).alias("source")), "row_id").groupBy("slot").agg(F.countDistinct("source").alias("k"), F.sum("words").alias("w"), F.first("source").alias("s"))
    slots = slots.orderBy("slot").collect()
    assert all(r.k == 1 and r.w <= 64 for r in slots)
    seen, blocks = Counter(), Counter(r.s for r in slots)
    for i, r in enumerate(slots, 1):
        seen[r.s] += 1
        assert all(abs(seen[s] - i * blocks[s] / len(slots)) <= 3 + math.log2(len(slots)) for s in blocks)


def test_mix_reruns_agree_and_empty(spark):
    once, again = (sorted(map(tuple, mixing.op1_mix_sources(spark, SF).collect())) for _ in range(2))
    assert once == again
    rows, takes = mixing.mix(cases.frame(spark, []), F.col("text"), F.col("source"), F.col("doc_id"), ["doc_id"])
    assert mixing.taken(rows, takes).count() == 0


# LM scoring


def losses(docs, good, share=lm_score.SHARE, least=lm_score.LEAST):
    texts = [(d, cases.words(cases.lower(t))) for d, t in docs]
    count = Counter(w for _, ws in texts for w in ws)
    limit = max(least, share * sum(count.values()))
    known = {w for w in count if count[w] >= limit}
    uni, pair, ctx = ([Counter(), Counter()] for _ in range(3))
    for d, ws in texts:
        before = "<s>"
        for w in ws:
            w = w if w in known else None
            for m in (0, 1) if d in good else (1,):
                uni[m][w] += 1
                pair[m][before, w] += 1
                ctx[m][before] += 1
            before = w
    kept = {b for b in pair[1] if pair[1][b] >= limit}
    held = [Counter(), Counter()]
    for m in (0, 1):
        for b in kept:
            if ctx[m][b[0]]:
                held[m][b[0]] += max(pair[m][b] - lm_score.DISCOUNT, 0) / ctx[m][b[0]]
    out = []
    for d, ws in texts:
        loss, before = [0.0, 0.0], "<s>"
        for w in ws:
            w = w if w in known else None
            for m in (0, 1):
                p = max(1 - held[m][before], 1e-12) * (uni[m][w] + lm_score.ADDED) / (sum(uni[m].values()) + lm_score.ADDED * (len(known) + 1))
                if (before, w) in kept and ctx[m][before]:
                    p += max(pair[m][before, w] - lm_score.DISCOUNT, 0) / ctx[m][before]
                loss[m] -= math.log(p)
            before = w
        out.append((d, len(ws), *((loss[0] / len(ws), loss[1] / len(ws)) if ws else (None, None))))
    return out


@pytest.mark.parametrize("edge", [True, False])
def test_lm_difference(spark, edge):
    df = cases.frame(spark) if edge else real(spark)
    chosen = spark.createDataFrame([(1,), (5,), (None,), (19,), (5,)], "doc_id long") if edge else real(spark, "labels").filter("quality = 1")
    models = lm_score.train(df.select("text"), lm_score.flagged(df, "doc_id", "text", chosen, "doc_id"))
    got = lm_score.scored(df, "doc_id", "text", models).collect()
    docs = [(r.doc_id, r.text) for r in df.collect()]
    expected = losses(docs, {r.doc_id for r in chosen.collect()} - {None})
    assert len(got) == len(expected)
    for a, b in zip(sorted(got, key=lambda r: cases.key(r[:2])), sorted(expected, key=lambda r: cases.key(r[:2])), strict=True):
        if a.doc_id in (19, None):  # several texts under one id
            continue
        assert (a.doc_id, a.n_words) == b[:2]
        assert (a.target_loss, a.background_loss) == pytest.approx(b[2:]) if b[1] else a.difference is None


def test_lm_rare_words_count(spark):
    """A word or bigram seen twice is known however many words there are."""
    rows = [(1, "a b c d e " * 640_000), (2, "rare pair alone"), (3, "rare pair again"), (4, "unseen"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = spark.createDataFrame([(2,), (3,)], "doc_id long")
    models = lm_score.train(df.select("text"), lm_score.flagged(df, "doc_id", "text", chosen, "doc_id"))
    got = {r.doc_id: r for r in lm_score.scored(df, "doc_id", "text", models).collect()}
    expected = losses(rows, {2, 3}, share=0)
    assert sorted(got) == sorted(r[0] for r in rows)
    for d, n, *loss in expected:
        assert got[d].n_words == n
        assert [got[d].target_loss, got[d].background_loss] == (pytest.approx(loss) if n else [None, None])


@pytest.mark.parametrize("least", [2, 4])
def test_lm_by_joins_alone(spark, least):
    df = real(spark)
    models = lm_score.train(df.select("text"), lm_score.flagged(df, "doc_id", "text", real(spark, "labels").filter("quality = 1"), "doc_id"), least=least, head=1.0)
    got = {r.doc_id: r for r in lm_score.scored(df, "doc_id", "text", models).collect()}
    good = {r.doc_id for r in real(spark, "labels").filter("quality = 1").collect()}
    for d, n, *loss in losses([(r.doc_id, r.text) for r in df.collect()], good, share=0, least=least):
        assert got[d].n_words == n
        assert not n or [got[d].target_loss, got[d].background_loss] == pytest.approx(loss)


def test_lm_empty(spark):
    df = cases.frame(spark, [])
    models = lm_score.train(df.select("text"), lm_score.flagged(df, "doc_id", "text", df, "doc_id"))
    assert lm_score.scored(df, "doc_id", "text", models).count() == 0
    assert lm_score.scored(cases.frame(spark), "doc_id", "text", models).count() == len(cases.documents())


# quality


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    rows = quality.op3_quality_votes(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_quality_edges(spark):
    df = cases.frame(spark)
    labels = spark.createDataFrame([(1, 1), (1, None), (5, 1), (17, 0), (None, 0), (19, 1), (16, 0), (999, 1), (17, 0)], "doc_id long, quality int")
    voters = quality.fit_voters(df, "doc_id", "text", labels, "doc_id", "quality")
    got = quality.with_score(df, "text", df.columns, voters).collect()
    assert len(got) == len(cases.documents()) and all(0 <= r["__score"] <= 1 for r in got)
    by_text: dict = {}
    for r in got:
        assert by_text.setdefault(r.text, r["__score"]) == r["__score"]
    none = quality.fit_voters(df, "doc_id", "text", labels.limit(0), "doc_id", "quality")
    assert {r["__score"] for r in quality.with_score(df, "text", ["doc_id"], none).collect()} == {0.5}
    empty = cases.frame(spark, [])
    assert quality.with_score(empty, "text", ["doc_id"], quality.fit_voters(empty, "doc_id", "text", labels, "doc_id", "quality")).count() == 0


def test_quality_votes_by_hand():
    import numpy as np

    voters = quality.Voters(np.ones(2, np.float32), np.eye(2, dtype=np.float32), np.eye(2, dtype=np.float32), np.array([1.0, 0.0], np.float32), 0.25)
    counts = np.array([[1, 0], [0, 3], [0, 0], [1, 1]], float)
    assert voters.scores(counts, neighbours=2).tolist() == pytest.approx([1.0, 0.0, 0.25, 0.5])


# suffix repeats


def cut(docs, length):
    raws = [(d, (t or "").encode()) for d, t in docs]
    count = Counter(b[i : i + length] for _, b in raws for i in range(len(b) - length + 1))
    out = []
    for d, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cut_by_spark(df, length, gram):
    out = repeats.without_repeats(df, "doc_id", "text", ["doc_id", *cases.CLASHES[:3]] if "size" in df.columns else ["doc_id"], length, gram)
    return out.select("doc_id", "__bytes", "__removed", "__runs", F.sha2("__kept", 256)).collect()


@pytest.mark.parametrize("case", ["edge", "short", "sliced", "real"])
def test_repeats(spark, case, monkeypatch):
    length, gram = (24, 5) if case in ("short", "sliced") else (200, 40)
    if case == "sliced":  # anchors with more variants than one slice; long texts in parts
        monkeypatch.setattr(repeats, "SLICE", 4)
        monkeypatch.setattr(repeats, "PIECE", 1000)
        monkeypatch.setattr(repeats.K, "CHUNK", 2000)
    df = real(spark).select("doc_id", "text") if case == "real" else cases.frame(spark)
    if case in ("short", "sliced"):
        df = df.withColumn("text", F.substring("text", 1, 3000))
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(map(tuple, cut_by_spark(df, length, gram)), key=cases.key)
    assert got == sorted(cut(docs, length), key=cases.key)


def test_repeats_as_text_and_empty(spark):
    text = "é" * 150 + "日本"
    df = spark.createDataFrame([(1, "ü" + text + "a"), (2, "ö" + text + "b"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r["__kept"] for r in repeats.without_repeats(df, "doc_id", "text", ["doc_id"], as_text=True).collect()}
    assert got == {1: "üa", 2: "öb", 3: None} or {k: v and v.strip() for k, v in got.items()} == {1: "a", 2: "b", 3: None}
    assert cut_by_spark(cases.frame(spark, []), 200, 40) == []


def test_suffix_order_is_sorted():
    import numpy as np

    r = np.random.default_rng(3)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    at = np.sort(r.choice(3800, 900, replace=False))
    lists = np.sort(r.integers(0, 7, 900))
    order = repeats.suffix_order(data, repeats.K.prefix_hashes(data), at, lists, 150)
    for i in range(7):
        own = [bytes(data[at[j] : at[j] + 150]) for j in order[lists == i]]
        assert own == sorted(own) and len(own) == (lists == i).sum()
        assert (lists[order[lists == i]] == i).all()


# token counts


def tokenizer(vocabulary):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(list(zip(vocabulary.pieces, vocabulary.scores, strict=True)), unk_id=0, byte_fallback=vocabulary.bytes_known))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always")
    return t


def test_token_counts_equal_the_library(spark):
    vocabulary = token_counts.read_model()
    df = cases.frame(spark).unionByName(real(spark), allowMissingColumns=True)
    rows = df.collect()
    got = sorted(map(tuple, token_counts.token_counts(df, "doc_id", "text", vocabulary).collect()), key=cases.key)
    library = tokenizer(vocabulary)
    assert got == sorted(((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows), key=cases.key)
    assert token_counts.token_counts(cases.frame(spark, []), "doc_id", "text", vocabulary).count() == 0


@pytest.mark.parametrize("bytes_known", [True, False])
def test_token_count_ties(bytes_known):
    import random

    r = random.Random(5)
    for _ in range(150):
        pieces = {"<unk>": 0.0}
        for _ in range(r.randrange(12)):
            pieces["".join(r.choice("ab▁c") for _ in range(r.randint(1, 4)))] = r.choice([-1.0, -2.0, -1.5, -3.0])
        if bytes_known:
            pieces |= {f"<0x{b:02X}>": 0.0 for b in range(256)}
        vocabulary = token_counts.Vocabulary(list(pieces), list(pieces.values()), bytes_known)
        library, counter = tokenizer(vocabulary), token_counts.Counter(vocabulary)
        for _ in range(15):
            text = "".join(r.choice("abcd é") for _ in range(r.randrange(14)))
            assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), (text, pieces)


# Jaccard join


def linked_groups(docs, k, percent):
    """The set size and the group number of each row; rows without a set are groups of their own."""
    sets = []
    for i, (d, t) in enumerate(docs):
        w = cases.words(cases.lower(t))
        sets.append((i, d, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, _, a in sets:
        for j, _, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    return [(len(s), top(i)) for i, _, s in sets]


def components(docs, k, percent):
    groups, least = linked_groups(docs, k, percent), {}
    for (d, _), (_, g) in zip(docs, groups, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return [(d, n, least.get(g) if n else d) for (d, _), (n, g) in zip(docs, groups, strict=True)]


@pytest.mark.parametrize("case", ["edge", "bands", "real"])
def test_jaccard_components(spark, case, monkeypatch):
    k, percent = (3, 90) if case != "bands" else (5, 80)
    if case == "bands":  # lists longer than these limits, few open pairs allowed
        monkeypatch.setattr(setjoin, "SHORT", 2)
        monkeypatch.setattr(setjoin, "FEW_PAIRS", 0)
    df = real(spark) if case == "real" else cases.frame(spark)
    got = setjoin.set_components(df, "doc_id", "text", k, percent).collect()
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=cases.key) == sorted(components(docs, k, percent), key=cases.key)
    groups = Counter(r.component_id for r in got if r.n_shingles and r.component_id is not None)
    stays = Counter(r.component_id for r in got if r.n_shingles and r.stays and r.component_id is not None)
    assert set(groups) == set(stays)


def test_jaccard_boundary_and_empty(spark):
    for m in range(1, 40):
        for n in range(m, 40):
            for percent in (80, 90):
                needed = setjoin.common_needed(m, n, percent)
                assert all((100 * i >= percent * (m + n - i)) == (i >= needed) for i in range(m + 1))
    assert setjoin.light_boundary({12: 1000}, 1e6, 90) >= 12 > setjoin.light_boundary({60: 1000}, 0.0, 90)
    assert setjoin.set_components(cases.frame(spark, []), "doc_id", "text").count() == 0


# decontamination


def held(docs, items):
    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    out = set()
    for d, t in docs:
        w = cases.words(cases.lower(t))
        for i, it in items:
            iw = cases.words(cases.lower(it))
            a = shingles(iw)
            if not w or not iw or i is None or (len(iw) < 5) != (len(w) < 5):
                continue
            for s in range(max(1, len(w) - len(iw) + 1)):
                b = shingles(w[s : s + len(iw)])
                common = sum((a & b).values())
                if common >= 0.8 * (sum(a.values()) + sum(b.values()) - common) - 1e-9:
                    out.add((d, i))
                    break
    return out


def test_leaks(spark):
    passage = cases.prose(2, 60)
    items = [(1, passage), (2, cases.edited(passage, [30])), (3, cases.prose(77, 40)), (4, "two words"), (5, None), (None, passage), (6, ""), (7, passage.upper()), (8, "A A A A A A")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = cases.frame(spark).filter("coalesce(doc_id, 0) <> 18")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    got = decontaminate.leaks(df, "doc_id", "text", bench, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in got} == held(docs, items)
    hit = {r.doc_id for r in got}
    left = decontaminate.without_leaks(df, "text", df.columns, bench, "item_id", "text")
    assert left.columns == df.columns
    assert sorted(map(cases.key, left.select("doc_id", "text").collect())) == sorted(cases.key(x) for x in docs if x[0] not in hit)
    assert decontaminate.leaks(df, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0
    assert decontaminate.leaks(df.limit(0), "doc_id", "text", bench, "item_id", "text").count() == 0


def test_leaks_of_real_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 15)  # several passes
    docs, items = real(spark), real(spark, "benchmark")
    got = decontaminate.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()
    pairs = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    near = [(d, t) for d, t in pairs[0] if d in {r.doc_id for r in got} or d % 10 == 0]
    assert {(r.doc_id, r.item_id) for r in got if r.doc_id in dict(near)} == held(near, pairs[1])
