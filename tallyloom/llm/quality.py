"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Features are words, hashed and in lower case, runs of character classes (letters
by case, digits, each punctuation mark, doubled or not) in windows of one to
three, and how often a word repeats the one before.  A truncated SVD of the
log-tf-idf matrix of a bounded sample of labelled texts gives the space.  Every document is projected,
its exact cosines with all labelled vectors are computed block by block, and its
nearest labelled vectors vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stable import stable_hash
from . import kernels as K
from .registry import register, table

SAMPLE = 3000  # labelled texts that the space and the voters are made of, at most
BITS = 11
WORD_BITS = 11
RUNS, WORDS = 1 << BITS, 1 << WORD_BITS
FEATURES = RUNS + WORDS + 2  # the last two: words that repeat the one before, and others
DIMENSIONS = 32
NEIGHBOURS = 40
POWER = 8  # of the similarity, as a vote's weight
THRESHOLD = 0.3
BLOCK = 1024  # documents whose cosines are computed together

LETTER, UPPER, DIGIT, BLANK, LINE, CONTROL, MARK = 1, 2, 3, 4, 5, 6, 7
CLASS = np.full(256, LETTER, np.uint8)  # bytes of letters beyond ASCII count as letters
CLASS[:33] = CONTROL
CLASS[127] = CONTROL
CLASS[K.SPACE] = BLANK
CLASS[ord("\n")] = LINE
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[ord("A") : ord("Z") + 1] = UPPER
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
CLASS[_marks] = MARK + np.arange(len(_marks))
KINDS = 2 * (MARK + len(_marks))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature counts, one row per text."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    if not len(data):
        return out
    kind = CLASS[data]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[offsets < len(kind)]] = True
    at = np.flatnonzero(new)
    doubled = np.diff(np.append(at, len(kind))) >= 2
    runs = kind[at].astype(np.int64)
    runs += (KINDS // 2) * (doubled & (runs >= MARK))
    doc = np.searchsorted(offsets, at, "right") - 1
    for k in (1, 2, 3):
        m = len(runs) - k + 1
        if m <= 0:
            continue
        code = np.full(m, k, np.int64)
        for i in range(k):
            code = code * KINDS + runs[i : m + i]
        same = doc[:m] == doc[k - 1 :]
        slot = (K.mix64(code[same].astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)
        size = n << BITS
        out[:, :RUNS] += np.bincount((doc[:m][same] << BITS) + slot, minlength=size).reshape(n, -1)
    start, stop, first = K.words(data, offsets)
    hashes = K.word_hashes(K.LOWER[data], start, stop)
    owner = np.repeat(np.arange(n), np.diff(first))
    slot = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    out[:, RUNS : RUNS + WORDS] = np.bincount((owner << WORD_BITS) + slot, minlength=n << WORD_BITS).reshape(n, -1)
    again = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out[:, -2] = np.bincount(owner[1:][again], minlength=n)
    out[:, -1] = np.diff(first) - out[:, -2]
    return out


def leading_axes(rows: np.ndarray, dimensions: int, rounds: int = 40) -> np.ndarray:
    """The leading right singular vectors as columns, by orthogonal iteration: no product as large as sample x sample is held."""
    k = min(dimensions, *rows.shape)
    if not k:
        return np.zeros((rows.shape[1], 1), np.float32)
    q = np.random.default_rng(3).standard_normal((len(rows), min(k + 16, len(rows)))).astype(np.float32)
    for _ in range(rounds):
        q = np.linalg.qr(rows @ (rows.T @ q))[0]
    left, values, _ = np.linalg.svd(rows.T @ q, full_matrices=False)
    return left[:, :k][:, values[:k] > 1e-3 * max(float(values[0]), 1e-9)] if values[0] > 0 else left[:, :1]


@dataclass
class Voters:
    """The latent-semantic space and the labelled vectors in it."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float  # share of label 1: the score of a text without features or neighbours

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Voters:
        idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)
        weighted = np.log1p(counts)
        weighted *= idf
        weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
        axes = leading_axes(weighted, dimensions)
        vectors = cls.unit(weighted @ axes)
        return cls(idf, axes.astype(np.float32), vectors.astype(np.float32), labels.astype(np.float32), float(labels.mean()) if len(labels) else 0.5)

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS, power: float = POWER) -> np.ndarray:
        out = np.full(len(counts), self.base)
        k = min(neighbours, len(self.labels))
        for a in range(0, len(counts) if k else 0, BLOCK):
            cosine = self.unit(self.unit(np.log1p(counts[a : a + BLOCK]) * self.idf) @ self.axes) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** power
            total = weight.sum(axis=1)
            votes = (weight * self.labels[near]).sum(axis=1)
            out[a : a + BLOCK] = np.where(total > 0, votes / np.maximum(total, 1e-300), self.base)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """One id in five, by the CRC-32 of its digits; rows without id too."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_voters(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str, sample: int = SAMPLE) -> Voters:
    """Voters from at most ``sample`` labelled documents that are not held out, taken by hash of their id.

    An id with several labels counts with their mean, rounded; null labels do not count.
    """
    known = labels.select(F.col(label_id).cast("bigint").alias("__id"), F.col(label).cast("double").alias("__y"))
    known = known.filter(F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.round(F.avg("__y")).alias("__y"))
    at = docs.select(F.col(doc_id).cast("bigint").alias("__id")).distinct().join(known, "__id")
    chosen = at.orderBy(stable_hash(F.col("__id")), "__id").limit(sample)
    few = F.broadcast(chosen)  # at most ``sample`` rows of two numbers
    texts = docs.select(F.col(doc_id).cast("bigint").alias("__id"), F.col(text).alias("__text")).join(few, "__id")

    def count(batches):
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column(1)):
                rows = features(data, offsets)
                held = [np.flatnonzero(r) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        K.blobs([h.astype("<u2") for h in held]),
                        K.blobs([r[h].astype("<f4") for r, h in zip(rows, held, strict=True)]),
                    ],
                    names=["id", "y", "at", "counts"],
                )

    rows = texts.select("__id", "__text", "__y").mapInArrow(count, "id long, y double, at binary, counts binary")
    got = rows.groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct("at", "counts")).alias("f")).collect()
    got.sort(key=lambda r: r["id"])
    counts = np.zeros((len(got), FEATURES), np.float32)
    for row, r in zip(counts, got, strict=True):
        row[np.frombuffer(r["f"]["at"], "<u2")] = np.frombuffer(r["f"]["counts"], "<f4")
    return Voters.fit(counts, np.array([r["y"] for r in got], float))


def with_score(docs: DataFrame, text: str, carry: Sequence[str], voters: Voters, name: str = "__score") -> DataFrame:
    """The ``carry`` columns of every row and its score, a DOUBLE from 0 to 1.

    A null or empty text has the score of the labelled sample's mean (0.5 without
    any sample); equal texts have equal scores; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField(name, T.DoubleType())])
    read = list(dict.fromkeys([*carry, text]))

    def score(batches):
        for batch in batches:
            got = [shared.value.scores(features(data, offsets)) for _, _, data, offsets in K.chunks(batch.column(read.index(text)))]
            scores = pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], scores], names=[*carry, name])

    return docs.select(*read).mapInArrow(score, schema)


@register("op3_quality_votes")
def op3_quality_votes(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    voters = fit_voters(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "quality")
    scored = with_score(docs, "text", ["doc_id"], voters, "score")
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
