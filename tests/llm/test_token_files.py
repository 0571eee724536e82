"""Token files: equal to the library's ids, exact round trip, keyed access."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import token_files as tf
from tests.llm import cases

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(path, texts, end=0):
    tokenizer = Tokenizer.from_file(path)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def odd_texts():
    r = random.Random(6)
    out = ["", " ", "  a", "a  ", "a \n b", "\n\n  foo", "don't 's 'S I'll", "x y z　w", "a\x1cb \x1f c\x85d", "<|endoftext|> a<|endoftext|>b", "tab\t\tx", "日本語 テスト", "🙂 🙂", "a\r\nb", "​ ᠎ x"]
    return out + ["".join(r.choice("ab'sé語9 \n\t.,  🙂-") for _ in range(r.randrange(60))) for _ in range(400)]


@pytest.mark.parametrize("path", [BPE, WORDS])
def test_encoder_equals_library(path):
    texts = odd_texts()
    encode = tf.Encoder(path, 4)
    assert encode.by_word == (path == BPE)
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts * 2] == [ids[:-1] for ids in plain_ids(path, texts * 2)]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tf, "CACHED", 5)
    texts = odd_texts()
    encode = tf.Encoder(BPE, 2)
    assert [np.frombuffer(encode(t), "<u2").tolist() for t in texts] == [ids[:-1] for ids in plain_ids(BPE, texts)]
    assert len(encode.words) <= 5 and len(encode.words.old) <= 5


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 20_000])
def test_minimal_perfect_hash(n):
    r = np.random.default_rng(n)
    keys = np.unique(np.concatenate([r.integers(-(1 << 62), 1 << 62, n // 2), np.arange(n - n // 2)])).astype(np.int64)
    parts = tf.build_hash(keys.view(np.uint64))
    slot = tf.slots(keys.view(np.uint64), *parts)
    assert sorted(slot.tolist()) == list(range(len(keys)))
    if n >= 64:
        assert parts[0].sum() < 8 * n


def test_block():
    keys = [None, None, -5, 3, 3, 3, 9]
    ids = [[1, 2], [], [3], [4, 5], [6], [7], [8] * 100]
    raw = tf.write_block(keys, [np.array(i, "<u2").tobytes() for i in ids], 2)
    block = tf.Block(raw + b"\n" + raw + b"\n", len(raw) + 1)
    assert [b.n for b in tf.blocks_of(raw + b"\n" + raw + b"\n")] == [7, 7]
    assert block.find(np.array([3, 9, -5, 0, 4, 1 << 60])).tolist() == [3, 6, 2, -1, -1, -1]
    assert list(block.same_key(3)) == [3, 4, 5] and list(block.same_key(6)) == [6]
    assert [block.ids(i).tolist() for i in range(7)] == ids
    with pytest.raises(ValueError):
        tf.Block(b"x" * 100, 0)


def check_files(spark, rows, path, tokenizer, **sizes):
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("part"), F.lit("x").alias("block"), F.lit(2).alias("ids"))
    tf.write_tokens(df, "doc_id", "text", path, tokenizer, **sizes)
    got = tf.with_start(tf.read_tokens(spark, path)).orderBy("start").collect()
    want = sorted(((d is not None, d or 0), ids) for (d, _), ids in zip(rows, plain_ids(tokenizer, [t for _, t in rows]), strict=True))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    upto = 0
    for r in got:
        assert r.start == upto and r.n_tokens == len(r.ids) // 4
        upto += r.n_tokens
    return want


@pytest.mark.parametrize("sizes", [{}, {"block_ids": 300, "block_records": 5, "file_blocks": 2}])
def test_round_trip_and_lookup(spark, tmp_path, monkeypatch, sizes):
    rows = [(d, t) for d, t, _ in cases.documents()] + [(7, f"hot key {i}") for i in range(200)] + [(1000 + 3 * i, t) for i, t in enumerate(odd_texts())]
    path = str(tmp_path / "ids")
    want = check_files(spark, rows, path, BPE, **sizes)
    asked = spark.createDataFrame([(7,), (7,), (1, ), (1003,), (1004,), (-5,), (None,), (10**15,), (-(10**15),)], "k long")
    expect = sorted((d, ids) for (named, d), ids in want if named and d in (7, 1, 1003, -5))
    for limit in (1 << 18, 0):  # bounds broadcast, and sorted in line with the keys
        monkeypatch.setattr(tf, "BROADCAST", limit)
        found = tf.lookup(spark, path, asked, "k").collect()
        assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found) == expect


def test_wide_ids_and_whole_texts(spark, tmp_path):
    assert tf.id_width(BPE, 0) == 2 and tf.id_width(BPE, 1 << 16) == 4
    check_files(spark, [(d, t) for d, t, _ in cases.documents()][:17], str(tmp_path / "ids"), WORDS)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "ids")
    tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", path, BPE)
    assert tf.with_start(tf.read_tokens(spark, path)).count() == 0
    assert tf.lookup(spark, path, spark.range(3), "id").count() == 0


def test_query(spark):
    got = sorted(map(tuple, tf.op13_token_files(spark, SF).collect()))
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, upto = [], 0
    for (d, _), ids in zip(docs, plain_ids(BPE, [t for _, t in docs]), strict=True):
        want.append((d, upto, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        upto += len(ids)
    assert got == want
