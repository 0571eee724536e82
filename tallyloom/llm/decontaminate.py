"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

For every item and every window of a text with as many words, the multiset of
five-word shingles decides: weighted Jaccard similarity (sum of minima over sum
of maxima of the counts) of at least ``SIMILARITY``.

1. A window can only reach it if that share of its shingle positions holds
   shingles of the benchmark; running sums of hits find those windows.
2. Their SimHash fingerprints come from running sums of the shingles' sign
   vectors.  An item is posted under every value of each block of bits that is
   within radius / blocks of its own, so a window finds all items within the
   radius by looking up its own blocks.
3. Found pairs within the radius are verified on the shingle counts themselves.

The radius lies 3.6 standard deviations above the distance that is expected at
the limit of similarity, where about two in ten thousand pairs are farther.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .registry import register, table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20  # of 64 bits
PARTS = 8  # blocks of bits
ITEMS = 20_000  # items that are searched for together, at most
ELEMENTS = 2_000_000  # shingles of those, at most, but for a single item

_SHIFTS = np.arange(64, dtype=np.uint64)
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each shingle."""
    return (((K.mix64(hashes)[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.int32) << 1) - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


@dataclass
class Items:
    """Benchmark items that are searched for together."""

    ids: list[int] = field(default_factory=list)
    sets: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # shingles and counts
    n_words: list[int] = field(default_factory=list)

    def ready(self) -> Items:
        self.sizes = np.array([int(c.sum()) for _, c in self.sets], np.int64)  # shingle positions
        self.words = np.array(self.n_words, np.int64)
        flat = np.concatenate([v for v, _ in self.sets])
        owner = np.repeat(np.arange(len(self.sets)), [len(v) for v, _ in self.sets])
        order = np.argsort(flat, kind="stable")
        self.shingles, self.owner = flat[order], owner[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(flat >> np.uint64(44)).astype(np.int64)] = True
        self.prints = fingerprints(np.array([(signs(v) * c[:, None]).sum(axis=0) for v, c in self.sets]))
        near = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // PARTS
        self.posted = [near[:, self.prints[:, p]] for p in range(PARTS)]  # [part][value, item]
        return self

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        out = self.maybe[(hashes >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        where = np.minimum(np.searchsorted(self.shingles, hashes[at]), len(self.shingles) - 1)
        out[at] = self.shingles[where] == hashes[at]
        return out

    def owners(self, hashes: np.ndarray) -> np.ndarray:
        """The items that hold one of the shingles."""
        lo, hi = np.searchsorted(self.shingles, hashes, "left"), np.searchsorted(self.shingles, hashes, "right")
        n = hi - lo
        return np.unique(self.owner[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)])

    def search(self, hashes: np.ndarray, hit: np.ndarray) -> list[tuple[int, float, int, int]]:
        """``(item, similarity, first word, words)`` of the best window of each item that a text holds."""
        total = np.concatenate([[0], np.cumsum(hit)])
        items = self.owners(hashes[hit])
        run = None
        found = []
        for size in np.unique(self.sizes[items]):
            wide = min(int(size), len(hashes))
            starts = np.flatnonzero(total[wide:] - total[:-wide] >= np.ceil(SIMILARITY * size - 1e-9))
            if not len(starts):
                continue
            if run is None:
                run = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(hashes), axis=0, dtype=np.int32)])
            own = items[self.sizes[items] == size]
            for a in range(0, len(starts), 4096):
                part = starts[a : a + 4096]
                prints = fingerprints(run[part + wide] - run[part])
                met = np.zeros((len(part), len(own)), bool)
                for p in range(PARTS):
                    met |= self.posted[p][prints[:, p]][:, own]
                w, i = np.nonzero(met)
                near = _ONES[prints[w] ^ self.prints[own[i]]].sum(axis=1) <= RADIUS
                for start, item in zip(part[w[near]].tolist(), own[i[near]].tolist(), strict=True):
                    found.append((item, self.similarity(hashes[start : start + wide], item), start, wide))
        best: dict[int, tuple[float, int, int]] = {}
        for item, similar, start, wide in found:
            if similar >= SIMILARITY - 1e-12 and (item not in best or similar > best[item][0]):
                best[item] = (similar, start, wide)
        return [(self.ids[i], s, start, wide + SHINGLE - 1) for i, (s, start, wide) in sorted(best.items())]

    def similarity(self, window: np.ndarray, item: int) -> float:
        values, counts = np.unique(window, return_counts=True)
        own, own_counts = self.sets[item]
        _, x, y = np.intersect1d(values, own, assume_unique=True, return_indices=True)
        common = int(np.minimum(counts[x], own_counts[y]).sum())
        return common / (int(counts.sum()) + int(own_counts.sum()) - common)


def shingled(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, shingle hashes, first shingle of each text, first word of each text)``, block by block."""
    for i, _, data, offsets in K.chunks(column):
        data = K.LOWER[data]
        start, stop, first = K.words(data, offsets)
        hashes, at = K.shingle_hashes(K.word_hashes(data, start, stop), first, SHINGLE)
        yield i, hashes, at, first


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, read partition by partition."""
    block, elements = Items(), 0
    rows = benchmark.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id is not null")
    for row in rows.toLocalIterator():
        for _, hashes, at, first in shingled(pa.array([row["text"]], pa.string())):
            if len(hashes):
                block.ids.append(row["id"])
                block.sets.append(np.unique(hashes, return_counts=True))
                block.n_words.append(int(first[-1] - first[0]))
                elements += len(hashes)
        if len(block.ids) >= ITEMS or elements >= ELEMENTS:
            yield block.ready()
            block, elements = Items(), 0
    if block.ids:
        yield block.ready()


def found_in(column: pa.Array, items: Items) -> list[list[tuple[int, float, int, int]]]:
    out: list[list] = [[] for _ in range(len(column))]
    for i, hashes, at, _ in shingled(column):
        hit = items.hits(hashes)
        total = np.concatenate([[0], np.cumsum(hit)])
        for j in np.flatnonzero(total[at[1:]] > total[at[:-1]]):
            a, b = at[j], at[j + 1]
            out[i + j] = items.search(hashes[a:b], hit[a:b])
    return out


def leaks(docs: DataFrame, doc_id: str, text: str, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word, n_words)``: the best window of each item that a document holds.

    Words are the runs between white space, A-Z in lower case.  A text of fewer
    words than the item is one window; an item or a text of fewer than five words
    is one shingle, so short items are found in equal short texts only.  Null or
    empty texts and items, and items without id, match nothing; equal documents
    give equal rows; other columns are ignored; empty tables give no rows.
    """
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, similarity double, first_word int, n_words int"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in item_blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches, shared=shared):
            for batch in batches:
                found = found_in(batch.column(1), shared.value)
                rows = [(d, *f) for d, fs in zip(batch.column(0).to_pylist(), found, strict=True) for f in fs]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"]
                )

        out = out.unionByName(read.mapInArrow(search, schema))
    return out


def without_leaks(docs: DataFrame, text: str, carry: Sequence[str], benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """The ``carry`` columns, ``text`` among them, of the rows that hold no item."""
    out, at = docs.select(*carry), list(carry).index(text)
    for items in item_blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches, shared=shared):
            for batch in batches:
                keep = pa.array([not f for f in found_in(batch.column(at), shared.value)], pa.bool_())
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns], names=list(carry))

        out = out.mapInArrow(clean, out.schema)
    return out


@register("op8_benchmark_leaks")
def op8_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
