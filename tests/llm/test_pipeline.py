"""The pipeline's stages on edge rows, and its result against brute force."""

from __future__ import annotations

import shutil
from collections import Counter

import pytest

import corpus_pipeline
from tallyloom.llm import quality
from tests.llm import cases
from tests.llm.test_documents import held, linked_groups, mixed


@pytest.fixture
def folder(tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path)
    return str(tmp_path)


def stages(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        path = f"{folder}/{name}"
        after.write.parquet(path)
        yield name, docs, (docs := spark.read.parquet(path))


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def kept_texts(docs, length):
    """Each row's text without the bytes of strings that start more than once; characters that lose a byte go."""
    raws = [(t or "").encode() for _, t in docs]
    count = Counter(b[i : i + length] for b in raws for i in range(len(b) - length + 1))
    out = []
    for (d, t), b in zip(docs, raws, strict=True):
        parts, at, stop = [], 0, 0
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                if i > stop:
                    parts.append(b[at:i])
                at = stop = i + length
        parts.append(b[at:])
        out.append((d, None if t is None else "".join(p.decode(errors="ignore") for p in parts)))
    return out


@pytest.mark.parametrize("edge", [True, False])
def test_each_stage(spark, folder, edge):
    docs = cases.frame(spark) if edge else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, before, after in stages(spark, docs, folder):
        was, now = pairs(before), pairs(after)
        if name == "quality":
            labels = spark.read.parquet(f"{folder}/labels.parquet")
            voters = quality.fit_voters(before, "doc_id", "text", labels, "doc_id", "quality")
            score = {r.text: r["__score"] for r in quality.with_score(before, "text", ["text"], voters).collect()}
            assert sorted(map(cases.key, now)) == sorted(cases.key(x) for x in was if score[x[1]] >= quality.THRESHOLD)
        elif name == "near_copies":
            groups: dict = {}
            for i, ((d, _), (n, g)) in enumerate(zip(was, linked_groups(was, 5, 80), strict=True)):
                groups.setdefault(g if n else ("empty", i), []).append((d is None, d))
            assert sorted(min(ids) for ids in groups.values()) == sorted((d is None, d) for d, _ in now)
            assert {t for _, t in now} <= {t for _, t in was}
        elif name == "repeats":
            assert sorted(map(cases.key, now)) == sorted(map(cases.key, kept_texts(was, 200)))
        elif name == "leaks":
            hit = {d for d, _ in held(was, items)}
            assert sorted(map(cases.key, now)) == sorted(cases.key(x) for x in was if x[0] not in hit)
        else:
            sizes, target = mixed([(r.doc_id, r.text, r.source) for r in before.collect()])
            got = [(r.source, r["taken"], r["size"]) for r in after.collect()]
            assert len(got) == len(was) and all(0 <= t <= 2 * s for _, t, s in got)
            for source in sizes:
                assert abs(sum(t for s, t, _ in got if s == source) - target[source]) <= 0.5


def test_run_and_empty_tables(spark, folder):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    got = sorted((r.doc_id, r.text) for r in out.collect())
    # the chain by hand: the voter's scores, then plain versions
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    voters = quality.fit_voters(docs, "doc_id", "text", spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "quality")
    rows = [(r.doc_id, r.text) for r in quality.with_score(docs, "text", ["doc_id", "text"], voters).collect() if r["__score"] >= quality.THRESHOLD]
    groups: dict = {}
    for i, ((d, t), (n, g)) in enumerate(zip(rows, linked_groups(rows, 5, 80), strict=True)):
        groups.setdefault(g if n else ("empty", i), []).append((d, t))
    rows = kept_texts([min(group) for group in groups.values()], 200)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {d for d, _ in held(rows, items)}
    assert got == sorted(x for x in rows if x[0] not in hit) and len(got) > 100
    cases.frame(spark, []).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
