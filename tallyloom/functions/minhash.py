"""Shingles and MinHash signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the prime and the two linear rules that give the coefficients
PRIME = 2147483647
A_RULE = (48271, 1013)
B_RULE = (69621, 7919)


def coefficients(m: int) -> tuple[np.ndarray, np.ndarray]:
    """a_i = 1 + (A0 * (i + A1)) mod (PRIME - 1), b_i = (B0 * (i + B1)) mod PRIME."""
    i = np.arange(m, dtype=np.int64)
    return 1 + (A_RULE[0] * (i + A_RULE[1])) % (PRIME - 1), (B_RULE[0] * (i + B_RULE[1])) % PRIME


def word_shingles(tokens: Column, n: int) -> Column:
    """Distinct n-word shingles; a shorter text is one shingle."""
    last = F.greatest(F.size(tokens) - n + 1, F.lit(1))
    rows = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.array_distinct(F.when(F.size(tokens) > 0, rows).otherwise(F.array().cast("array<string>")))


def shingle_hashes(shingles: Column) -> Column:
    """31-bit values that other engines can repeat."""
    return F.transform(shingles, lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") % PRIME)


def shingled(df: DataFrame, keep: list[str], tokens: str, n: int) -> DataFrame:
    """``(keep, __h)`` with the array of shingle hashes.

    The one-element generator keeps the token expression from being merged into
    the per-shingle lambda, where it would be evaluated once per shingle.
    """
    ready = df.select(*keep, F.explode(F.array(F.col(tokens))).alias("__tok"))
    return ready.select(*keep, shingle_hashes(word_shingles(F.col("__tok"), n)).alias("__h"))


def token_hashes(tokens: list[bytes | None], n: int) -> np.ndarray:
    """The values that ``shingle_hashes`` gives the ``word_shingles`` of one text, in the order of the text and with repeats."""
    last = max(len(tokens) - n + 1, 1)
    if None in tokens:
        rows = [b" ".join(t for t in tokens[i : i + n] if t is not None) for i in range(last)]
    else:  # a shingle is a part of the joined text
        flat, sizes = b" ".join(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[:last].tolist()
        rows = [flat[i:j] for i, j in zip(starts, ends[-last:].tolist(), strict=True)]
    heads = b"".join([hashlib.md5(s, usedforsecurity=False).digest()[:4] for s in rows])
    return np.frombuffer(heads, ">u4").astype(np.int64) % PRIME


def minima(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of (a_i * h + b_i) mod PRIME; a repeated hash changes none."""
    best = np.full(len(a), PRIME, dtype=np.int64)
    for s in range(0, len(h), 512):  # bounds the work arrays, which stay in the processor's cache
        x = h[s : s + 512, None] * a + b
        x -= x // PRIME * PRIME  # faster than the remainder
        best = np.minimum(best, x.min(axis=0))
    return best


def minhash_signatures(df: DataFrame, id_col: str, tokens: str, n: int, m: int = 128) -> DataFrame:
    """``(id, sig)`` for texts with at least one token; texts are unpacked one at a time."""
    held = df.select(id_col, tokens)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(m)
        for batch in batches:
            texts = batch.column(1).cast(pa.list_(pa.binary()))
            places, sigs = [], []
            for i, text in enumerate(texts):
                words = text.values.to_numpy(zero_copy_only=False).tolist() if text.is_valid else []
                if words:
                    places.append(i)
                    sigs.append(minima(token_hashes(words, n), a, b).astype(np.int32))
            flat = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))
            ends = pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * m)
            ids = batch.column(0).take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, flat)], names=[id_col, "sig"])

    return held.mapInArrow(sign, T.StructType([held.schema[id_col], T.StructField("sig", T.ArrayType(T.IntegerType()))]))


def minhash_of_rows(rows: DataFrame, key: str, hash_col: str, m: int = 128) -> DataFrame:
    """Signatures when the shingles of one key are spread over many rows.

    Minima combine before the shuffle, so a key with a third of all shingles
    sends one row per task.
    """
    a, b = coefficients(m)
    minima = [F.min((F.col(hash_col) * int(a[i]) + int(b[i])) % PRIME).cast("int").alias(f"m{i}") for i in range(m)]
    return rows.groupBy(key).agg(*minima).select(key, F.array(*[F.col(f"m{i}") for i in range(m)]).alias("sig"))


def agreement(a: Column, b: Column) -> Column:
    """Number of equal positions of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v))
