"""Numpy helpers over the UTF-8 bytes of many texts at once, for use inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text worked on together; one longer text is one chunk
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for i, base in enumerate((BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all of them."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def windows(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on as one number, lowest first; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), "<u8", padded.data, strides=(1,))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hashes modulo 2**64 of the mixed 8-byte windows: one more value than bytes.

    Polynomials of the bytes themselves would be equal for some regular strings
    (of two letters that are swapped, say), whatever the base.
    """
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix64(windows(data)) * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the bytes ``start:stop``, 8 at least; equal bytes have equal hashes wherever they stand."""
    return (prefix[stop - 7] - prefix[start]) * powers(len(prefix))[1][start]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of texts of about ``size`` bytes; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, stop, first)``: spans of the words, and each text's first word (one more value than texts)."""
    inside = ~SPACE[data]
    edges = np.unique(offsets)
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    return start, stop, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the bytes ``start:stop``, 8 bytes after the other mixed in; of longer words the hashes of 64-byte parts are hashed."""
    length = stop - start
    out = mix64(length.astype(np.uint64) + np.uint64(1))
    if not len(start):
        return out
    at = windows(data)
    todo = np.flatnonzero(length <= 64)
    for done in range(0, 64, 8):
        todo = todo[length[todo] > done]
        if not len(todo):
            break
        block = at[start[todo] + done]
        left = length[todo] - done
        part = left < 8
        block[part] &= (np.uint64(1) << (left[part] * 8).astype(np.uint64)) - np.uint64(1)
        out[todo] = mix64((out[todo] ^ block) * np.uint64(BASE) + np.uint64(done))
    long = np.flatnonzero(length > 64)
    if len(long):
        parts = -(-length[long] // 64)
        upto = np.cumsum(parts)
        nth = np.arange(int(upto[-1])) - np.repeat(upto - parts, parts)
        begin = np.repeat(start[long], parts) + 64 * nth
        inner = word_hashes(data, begin, np.minimum(begin + 64, np.repeat(stop[long], parts)))
        out[long] = mix64(out[long] ^ word_hashes(inner.view(np.uint8), 8 * (upto - parts), 8 * upto))
    return out


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, first)`` of every run of k words in a text, in order; a text of fewer words is one run."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - k + 1
    full = np.flatnonzero(doc[:n] == doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def run(at: np.ndarray, length: int) -> np.ndarray:
        acc = np.full(len(at), length, np.uint64)
        for i in range(length):
            acc = mix64(acc * np.uint64(BASE) + hashes[at + i])
        return acc

    parts, owners = [run(full, k)], [doc[full]]
    for length in range(1, k):
        short = np.flatnonzero(counts == length)
        parts.append(run(first[short], length))
        owners.append(short)
    value, owner = np.concatenate(parts), np.concatenate(owners)
    if len(full) < len(value):
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrays of different lengths as one list column."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def blobs(values: list[np.ndarray]) -> pa.Array:
    """Arrays as one binary column."""
    return pa.array([v.tobytes() for v in values], pa.binary())
