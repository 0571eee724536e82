"""Suffix-array dedup: bytes covered by strings of ``length`` bytes that start more than once.

1. Every window of ``length`` bytes has an anchor: its ``gram``-byte string of
   least hash, the last of equals.  Equal windows have equal anchors at equal
   places, so only windows of one anchor string can be equal.  Neighbouring
   windows with one anchor form a segment; a text has about two segments per
   ``length`` bytes.
2. Segments whose anchor string occurs once hold no repeat.  Equal segments
   repeat as a whole.
3. The windows of the other segments, whose anchor occurs but not with the same
   surroundings, are sorted as suffixes in lists of one anchor and place:
   mergesort whose comparisons find the longest common extension by binary search
   over polynomial prefix hashes of mixed windows.  Neighbours with ``length`` bytes in common are
   compared byte by byte and then repeat.
4. An anchor with very many different segments is cut into slices that are
   sorted on their own; what is new in each slice then meets by window hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from . import kernels as K
from .registry import register, table

LENGTH = 200
GRAM = 40
PIECE = 1 << 20  # bytes of text that are worked on together; a longer text comes in parts
SLICE = 8192  # different segments of an anchor that are sorted together
SORTED = 400_000  # suffixes sorted together in a task

SEGMENTS = "anchor long, content long, doc_id long, text_hash long, start int, n int, place int"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by block-wise running minima from both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """``doc, start, n, place, anchor, content`` of all segments of the texts; ``place``: the anchor's distance from ``start``."""
    windows = len(data) - length + 1
    if windows <= 0:
        return {k: np.zeros(0, np.int64) for k in ("doc", "start", "n", "place", "anchor", "content")}
    prefix = K.prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    short = K.windows(data)[at] & np.uint64((1 << 8 * gram) - 1) if gram < 8 else None
    grams = K.mix64(K.span_hashes(prefix, at, at + gram) if short is None else short)
    low = np.uint64((1 << 24) - 1)
    least = sliding_least((grams & ~low) | (low - at.astype(np.uint64)), length - gram + 1)
    anchor = (low - (least & low)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = doc[:windows] == doc[length - 1 : length - 1 + windows]
    starts = np.flatnonzero(valid)
    a = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[starts[1:]] != doc[starts[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    start, a = starts[first], a[first]
    content = K.mix64(K.span_hashes(prefix, start, start + n + length - 1) ^ n.astype(np.uint64))
    return {"doc": doc[start], "start": start - offsets[doc[start]], "n": n, "place": a - start, "anchor": grams[a], "content": content}


def pieces(column: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets, start of each text)``; a very long text comes in overlapping parts."""
    for i, j, data, offsets in K.chunks(column, PIECE):
        if j - i > 1 or len(data) <= PIECE + length:
            yield i, data, offsets, np.zeros(j - i, np.int64)
            continue
        for at in range(0, len(data) - length + 1, PIECE):
            part = data[at : at + PIECE + length - 1]
            yield i, part, np.array([0, len(part)]), np.array([at])


def find_segments(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Segment rows of ``(doc_id, text_hash, text)`` rows."""

    def find(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            for i, data, offsets, origin in pieces(batch.column(2), length):
                s = segments(data, offsets, length, gram)
                rows = pa.array(s["doc"] + i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s["anchor"].astype(np.int64)),
                        pa.array(s["content"].astype(np.int64)),
                        ids.take(rows),
                        hashes.take(rows),
                        pa.array((s["start"] + origin[s["doc"]]).astype(np.int32) if len(origin) else np.zeros(0, np.int32)),
                        pa.array(s["n"].astype(np.int32)),
                        pa.array(s["place"].astype(np.int32)),
                    ],
                    names=["anchor", "content", "doc_id", "text_hash", "start", "n", "place"],
                )

    return texts.mapInArrow(find, SEGMENTS)


def common_extension(at: np.ndarray, prefix: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """How many bytes from ``p`` and from ``q`` on are equal, up to ``most``: binary search over prefix hashes.

    ``at`` holds the 8-byte windows that the prefix hashes run over; the first
    one that differs tells the byte.
    """
    low, high = np.zeros(len(p), np.int64), np.full(len(p), most - 7, np.int64)  # equal windows
    step = K.powers(len(prefix))[1]
    a, b, pa_, pb = prefix[p], prefix[q], step[p], step[q]
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = (prefix[p + mid] - a) * pa_ == (prefix[q + mid] - b) * pb
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    reach = np.minimum(low, most - 8)
    differ = at[p + reach] ^ at[q + reach]
    bytes_equal = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
    return np.where(low > most - 8, most, np.minimum(low + bytes_equal, most))


def suffix_order(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, lists: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes ``at`` within each list: mergesort from below over all lists at once.

    ``lists`` numbers the list of each suffix, in ascending order.
    """
    begin = np.searchsorted(lists, lists, "left")
    end = np.searchsorted(lists, lists, "right")
    order = np.arange(len(at))
    windows = K.windows(data)
    width, longest = 1, int((end - begin).max()) if len(at) else 0
    while width < longest:
        slot = np.arange(len(at))
        run = (slot - begin) // width
        pair = begin + (run // 2) * 2 * width
        left = run % 2 == 0
        other = np.minimum(np.where(left, pair + width, pair), end)
        low, high = other.copy(), np.minimum(np.where(left, pair + 2 * width, pair + width), end)
        mine = at[order]
        todo = np.flatnonzero(low < high)
        while len(todo):
            mid = (low[todo] + high[todo]) >> 1
            p, q = mine[todo], at[order[mid]]
            ext = common_extension(windows, prefix, p, q, most)
            x, y = data[p + np.minimum(ext, most - 1)], data[q + np.minimum(ext, most - 1)]
            equal = ext >= most
            before = np.where(equal, ~left[todo], y < x)  # the other run's suffix comes first
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        own = slot - (pair + np.where(left, 0, width))
        target = pair + own + (low - other)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def repeated_windows(contents: list[np.ndarray], n: np.ndarray, place: np.ndarray, lists: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(segment, window, repeats)`` of every window of the segments, sorted in lists of one anchor and place."""
    data = np.concatenate(contents)
    prefix = K.prefix_hashes(data)
    base = np.concatenate([[0], np.cumsum([len(c) for c in contents])[:-1]])
    segment = np.repeat(np.arange(len(n)), n)
    window = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = base[segment] + window
    key = lists[segment] * np.int64(length) + (place[segment] - window)
    by = np.argsort(key, kind="stable")
    segment, window, at, key = segment[by], window[by], at[by], key[by]
    order = suffix_order(data, prefix, at, key, length)
    p, q = at[order[:-1]], at[order[1:]]
    near = np.flatnonzero(key[order[:-1]] == key[order[1:]])
    near = near[common_extension(K.windows(data), prefix, p[near], q[near], length) >= length]
    reach = np.arange(length)
    for i in range(0, len(near), 50_000):  # the bytes themselves, against equal hashes of different strings
        part = near[i : i + 50_000]
        same = (data[p[part][:, None] + reach] == data[q[part][:, None] + reach]).all(axis=1)
        near[i : i + 50_000] = np.where(same, part, -1)
    near = near[near >= 0]
    repeats = np.zeros(len(at), bool)
    repeats[order[near]] = True
    repeats[order[near + 1]] = True
    return segment, window, repeats


SORTED_SCHEMA = "doc_id long, text_hash long, anchor long, start int, n int, hash long, fresh boolean"


def sort_segments(group_rows: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows, and the other windows' hashes where an anchor has several slices.

    Rows ``(anchor, slice, slices, doc_id, text_hash, start, n, place, bytes)``
    lie in partitions by anchor and slice, sorted so.  ``fresh`` rows are windows
    (``n`` = 1) not repeated within their slice, with their hash; one row of each
    repeated window of such a slice carries its hash too.
    """

    def emit(rows: list[tuple]):
        contents = [np.frombuffer(r[8], np.uint8) for r in rows]
        n = np.array([r[6] for r in rows], np.int64)
        place = np.array([r[7] for r in rows], np.int64)
        lists = np.cumsum([0] + [a[:2] != b[:2] for a, b in zip(rows[:-1], rows[1:], strict=True)])
        segment, window, repeats = repeated_windows(contents, n, place, lists, length)
        back = np.lexsort((window, segment))
        segment, window, repeats = segment[back], window[back], repeats[back]
        starts = np.array([r[5] for r in rows], np.int64)
        out = []
        hit = np.flatnonzero(repeats)
        if len(hit):
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(hit) != 1) | (segment[hit[1:]] != segment[hit[:-1]])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(hit)))
            s = segment[hit[first]]
            out.append((s, starts[s] + window[hit[first]], size, np.zeros(len(s), np.int64), np.zeros(len(s), bool)))
        many = np.array([r[2] for r in rows]) > 1
        if many.any():
            w = np.flatnonzero(many[segment])
            data = np.concatenate(contents)
            base = np.concatenate([[0], np.cumsum([len(c) for c in contents])[:-1]])
            at = base[segment[w]] + window[w]
            hashes = K.mix64(K.span_hashes(K.prefix_hashes(data), at, at + length)).astype(np.int64)
            # one row of each repeated window of a slice is enough
            key = np.rec.fromarrays([lists[segment[w]], hashes])
            _, one = np.unique(key, return_index=True)
            keep = ~repeats[w]
            keep[one] = True
            w, hashes = w[keep], hashes[keep]
            out.append((segment[w], starts[segment[w]] + window[w], np.ones(len(w), np.int64), hashes, np.ones(len(w), bool)))
        for s, start, size, hashes, fresh in out:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][3] for i in s], pa.int64()),
                    pa.array([rows[i][4] for i in s], pa.int64()),
                    pa.array([rows[i][0] for i in s], pa.int64()),
                    pa.array(start.astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                    pa.array(hashes),
                    pa.array(fresh),
                ],
                names=["doc_id", "text_hash", "anchor", "start", "n", "hash", "fresh"],
            )

    def work(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SORTED and row[:2] != held[-1][:2]:
                    yield from emit(held)
                    held, size = [], 0
                held.append(row)
                size += row[6]
        if held:
            yield from emit(held)

    return group_rows.mapInArrow(work, SORTED_SCHEMA)


def cut_segments(texts: DataFrame, length: int) -> DataFrame:
    """``(anchor, content, doc_id, text_hash, start, n, place, bytes)`` of ``(doc_id, text_hash, text, wanted)`` rows."""

    def cut(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc_id, text_hash, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for w in wanted:
                    values = (w["anchor"], w["content"], doc_id, text_hash, w["start"], w["n"], w["place"], raw[w["start"] : w["start"] + w["n"] + length - 1])
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["anchor", "content", "doc_id", "text_hash", "start", "n", "place", "bytes"],
            )

    return texts.mapInArrow(cut, f"{SEGMENTS}, bytes binary")


def repeated_spans(source: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, text_hash, spans)`` of ``(doc_id, text_hash, text)`` rows with repeats; ``spans``: starts and window counts."""
    found = materialise(find_segments(source.filter(F.octet_length("text") >= length), length, gram), "segments")
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor")
    found = materialise(found.join(shared, "anchor"), "shared")
    kinds = found.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash", "start", "n", "place")).alias("one")
    )
    kinds = materialise(kinds, "kinds")
    variants = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("variants"), F.min("copies").alias("least"))
    whole = found.join(kinds.filter("copies > 1").select("anchor", "content"), ["anchor", "content"]).select("doc_id", "text_hash", "start", "n")

    # one segment of each kind, where an anchor has several and one of them only once
    mixed = kinds.join(variants.filter("variants > 1 and least = 1"), "anchor")
    wanted = mixed.select("one.doc_id", "one.text_hash", F.struct("anchor", "content", "one.start", "one.n", "one.place").alias("w"))
    wanted = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("w").alias("wanted"))
    wanted = wanted.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), "wanted")
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")))
    texts = texts.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "wanted")
    slices = F.ceil(F.col("variants") / SLICE).cast("int")
    cut = cut_segments(texts, length).join(variants.select("anchor", slices.alias("slices")), "anchor")
    cut = cut.withColumn("slice", F.pmod("content", "slices").cast("int"))
    cut = cut.select("anchor", "slice", "slices", "doc_id", "text_hash", "start", "n", "place", "bytes")
    runs = materialise(sort_segments(cut.repartition("anchor", "slice").sortWithinPartitions("anchor", "slice"), length), "runs")
    fresh = runs.filter("fresh")
    met = fresh.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor", "hash")
    late = fresh.join(met, ["anchor", "hash"]).select("doc_id", "text_hash", "start", "n")
    spans = whole.unionByName(runs.filter("not fresh").select("doc_id", "text_hash", "start", "n")).unionByName(late)
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def merged(spans, length: int, size: int) -> list[tuple[int, int]]:
    """Disjoint byte ranges of the windows ``spans``, touching ones joined."""
    out: list[list[int]] = []
    for start, n in sorted((s["start"], s["n"]) for s in spans or ()):
        stop = min(size, start + n + length - 1)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def without_repeats(
    docs: DataFrame, doc_id: str, text: str, carry: list[str], length: int = LENGTH, gram: int = GRAM, as_text: bool = False
) -> DataFrame:
    """The ``carry`` columns of every row with ``__kept``, ``__bytes``, ``__removed``, ``__runs``.

    ``__kept`` is the BINARY of the bytes that are left or, ``as_text``, the
    STRING of the characters that are left whole.

    A null text is empty (and null as text); texts under ``length`` bytes keep all.  Equal rows are
    copies of each other, and so are equal texts under different ids: all lose
    their text.  A null id is an id.  Other columns are ignored.
    """
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), own.alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = repeated_spans(source, length, gram)
    keyed = docs.select(F.col(doc_id).cast("bigint").alias("__d"), own.alias("__h"), F.col(text).alias("__text"), F.struct(*carry).alias("__row"))
    joined = keyed.join(spans, F.col("__d").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.col("text_hash")), "left")
    kinds = T.StructType(
        [
            T.StructField("__row", keyed.schema["__row"].dataType),
            T.StructField("__kept", T.StringType() if as_text else T.BinaryType()),
            *(T.StructField(c, T.LongType()) for c in ("__bytes", "__removed", "__runs")),
        ]
    )

    def cut(batches):
        for batch in batches:
            kept, sizes, removed, runs = [], [], [], []
            for content, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (content or "").encode()
                ranges = merged(found, length, len(raw))
                stops = [0, *(b for _, b in ranges)]
                parts = [raw[a:b] for a, b in zip(stops, [*(a for a, _ in ranges), len(raw)], strict=True)]
                if as_text:
                    kept.append(None if content is None else "".join(x.decode(errors="ignore") for x in parts))
                else:
                    kept.append(b"".join(parts))
                sizes.append(len(raw))
                removed.append(len(raw) - sum(map(len, parts)))
                runs.append(len(ranges))
            numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, runs)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(kept, pa.string() if as_text else pa.binary()), *numbers], names=["__row", "__kept", "__bytes", "__removed", "__runs"])

    out = joined.select("__text", "spans", "__row").mapInArrow(cut, kinds)
    return out.select(*[F.col("__row")[c].alias(c) for c in carry], "__kept", "__bytes", "__removed", "__runs")


@register("op5_suffix_repeats")
def op5_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", ["doc_id"])
    return out.select(
        "doc_id",
        F.col("__bytes").alias("n_bytes"),
        F.col("__removed").alias("n_removed"),
        F.col("__runs").alias("n_spans"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )
