"""The voter against a plain version: features, projection and votes."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import kernels as K
from tallyloom.llm import quality as q
from tests.llm import cases


def texts():
    r = random.Random(4)
    marks = [".", ",", "!!", "?", " - ", "\n", "\t", "  "]
    made = ["".join(r.choice(["Word", "the", "the the", "7", "x9", "É", "日本"]) + r.choice([" ", " ", *marks]) for _ in range(r.randrange(1, 80))) for _ in range(150)]
    return [t or "" for _, t, _ in cases.documents() if len(t or "") < 6000][:40] + made


def plain_features(text):
    """Dicts of counts by the same definitions, a text at a time."""
    raw = text.encode()
    runs = []
    for m in re.finditer(rb"(?s)(.)", raw):
        kind = int(q.CLASS[m[1][0]])
        if runs and runs[-1][0] == kind:
            runs[-1][1] += 1
        else:
            runs.append([kind, 1])
    codes = [kind + (q.KINDS // 2) * (n >= 2 and kind >= q.MARK) for kind, n in runs]
    out = {}
    for k in (1, 2, 3):
        for i in range(len(codes) - k + 1):
            code = k
            for c in codes[i : i + k]:
                code = code * q.KINDS + c
            slot = int(K.mix64(np.array([code], np.uint64))[0]) >> (64 - q.BITS)
            out[slot] = out.get(slot, 0) + 1
    words = [w.encode() for w in cases.words(cases.lower(text))]
    for w in words:
        data = np.frombuffer(w, np.uint8)
        slot = q.RUNS + (int(K.word_hashes(data, np.array([0]), np.array([len(w)]))[0]) >> (64 - q.WORD_BITS))
        out[slot] = out.get(slot, 0) + 1
    again = sum(a == b for a, b in zip(words[:-1], words[1:], strict=True)) if words else 0
    return {k: v for k, v in {**out, q.FEATURES - 2: again, q.FEATURES - 1: len(words) - again}.items() if v}


def counted(rows):
    return np.concatenate([q.features(data, offsets) for _, _, data, offsets in K.chunks(pa.array(rows), 3000)])


def test_features():
    rows = texts()
    got = counted(rows)
    for text, row in zip(rows, got, strict=True):
        assert {int(i): float(row[i]) for i in np.flatnonzero(row)} == plain_features(text)


def test_projection_and_votes():
    counts = counted(texts()).astype(float)
    r = np.random.default_rng(1)
    labels = r.integers(0, 2, 120).astype(float)
    known, asked = counts[:120], counts[100:]
    voters = q.Voters.fit(known.astype(np.float32), labels, 10)
    idf = np.log(121 / (1 + (known > 0).sum(axis=0))) + 0.1
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    weighted = unit(np.log1p(known) * idf)
    axes = np.linalg.svd(weighted, full_matrices=False)[2][:10].T
    vectors = unit(weighted @ axes)
    want = []
    for row in asked:
        cosine = vectors @ unit(unit(np.log1p(row[None]) * idf) @ axes)[0]
        near = sorted(range(120), key=lambda i: -cosine[i])[:7]
        weight = [max(cosine[i], 0) ** 8 for i in near]
        want.append(sum(w * labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight) if sum(weight) else voters.base)
    got = voters.scores(asked.astype(np.float32), 7, 8)
    close = np.abs(got - want) < 1e-3
    assert close.mean() > 0.95  # ties at the seventh place may fall otherwise


def test_words_alone_tell_classes_apart():
    """Two classes of texts with words of their own, alike in everything else."""
    r = np.random.default_rng(1)
    classes = r.integers(0, 2, 300)
    rows = [" ".join("".join(r.choice(list("abcde" if c else "fghij"), 4)) for _ in range(30)) for c in classes]
    counts = counted(rows)
    voters = q.Voters.fit(counts[:200], classes[:200].astype(float))
    assert ((voters.scores(counts[200:]) >= 0.5) == classes[200:]).mean() > 0.95


def test_large_counts_are_whole():
    """A very long labelled text and the same text scored have one vector."""
    counts = counted(["a b " * 60_000, "c, d! " * 500])
    voters = q.Voters.fit(counts, np.array([1.0, 0.0]))
    assert voters.scores(counts, 1).tolist() == pytest.approx([1.0, 0.0])
