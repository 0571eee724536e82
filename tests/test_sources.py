"""Readers in the forms that no registered query meets."""

from __future__ import annotations

import gzip
import json

import pytest

from tallyloom.operators import ngram_model as nm
from tallyloom.sources import corpus, tables
from tests.test_ngram_model import corpus as lines_of


def test_corpus_of_several_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one two\r\n\n three\x00four\tfive\rsix\n<s> x </s>\n")
    with gzip.open(tmp_path / "b.gz", "wb") as f:
        f.write("é ü\nlast without end".encode())
    got = corpus.read_corpus(spark, str(tmp_path)).collect()
    assert sorted(r.tokens for r in got) == sorted([["one", "two"], [], ["three", "four", "five", "six"], ["x"], ["é", "ü"], ["last", "without", "end"]])
    assert {r.file.rsplit("/", 1)[1] for r in got} == {"a.txt", "b.gz"}
    only = corpus.read_corpus(spark, [str(tmp_path / "b.gz")], strict=True)
    assert only.count() == 2
    with pytest.raises(Exception, match="special word"):
        corpus.read_corpus(spark, str(tmp_path), strict=True).collect()


def test_questions_of_a_json_list(spark, tmp_path):
    said = [{"role": "system", "content": "s"}, {"role": "user", "content": "note User: why? "}]
    rows = [{"question": "how?", "answer": "so"}, {"question": " ", "answer": "a"}, {"messages": said, "answer": "b"}, {"question": "", "messages": [{"role": "u", "content": "x"}, {"role": "u", "content": "plain"}]}]
    (tmp_path / "q.json").write_text(json.dumps(rows, indent=1))
    got = tables.read_questions(spark, str(tmp_path / "q.json"), multi_line=True).collect()
    assert sorted((r.question, r.answer or "") for r in got) == [("how?", "so"), ("plain", ""), ("why?", "b")]


def test_episodes_are_sampled_by_file(spark, tmp_path):
    for split, k in (("train", 6), ("val", 2)):
        for i in range(k):
            spark.range(i + 1).selectExpr(f"'{split}{i}' AS episode", "id AS frame").coalesce(1).write.parquet(str(tmp_path / split / f"ep{i}"))
    read = lambda seed: sorted(map(tuple, tables.read_episodes(spark, str(tmp_path), ["train", "val"], ["episode"], 3, seed).distinct().collect()))
    one = read(1)
    assert one == read(1) and len([s for s, _ in one if s == "train"]) == 3 and len([s for s, _ in one if s == "val"]) == 2
    assert len({tuple(read(s)) for s in range(6)}) > 1
    whole = tables.read_episodes(spark, str(tmp_path), ["train", "val"], ["episode", "frame"])
    assert whole.count() == 21 + 3


def test_unigrams_without_interpolation_and_with_a_pad(spark):
    """The unknown word has the whole rest without interpolation; a padded vocabulary leaves words unnamed."""
    def unigrams(**options):
        lm = nm.train(lines_of(spark, ["a b a", "b c a"]), 2, nm.FALLBACK_DISCOUNTS, **options)
        return {r.words: 10**r.prob for r in lm.filter("order = 1").collect() if r.words != "<s>"}

    plain, alone, padded = unigrams(), unigrams(interpolate_unigrams=False), unigrams(vocab_pad=100)
    assert sum(plain.values()) == pytest.approx(1.0) and sum(alone.values()) == pytest.approx(1.0)
    rest = len(plain) * plain["<unk>"]  # dealt to all words alike
    assert alone["<unk>"] == pytest.approx(rest) and alone["a"] == 0.0  # all of its count is discounted
    assert {w: alone[w] + plain["<unk>"] for w in alone if w != "<unk>"} == pytest.approx({w: p for w, p in plain.items() if w != "<unk>"})
    assert padded["<unk>"] == pytest.approx(rest / 100) and sum(padded.values()) < 1
