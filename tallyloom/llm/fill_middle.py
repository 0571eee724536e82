"""Fill-in-middle transformation: each text is cut twice and its parts are reordered around marks.

A text is a row of units (code points, words or lines).  Its UTF-8 bytes are cut
into blocks of fixed length; a Fenwick tree over the blocks holds how many units
and how many code points begin in each.  A cut after u units descends the tree by
halving steps to the block in which unit u begins, and only that block is
searched for the byte where it does.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import kernels as K
from .registry import register, table

BLOCK = 1024  # bytes of a text block
MARKS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
PLAIN_FROM = 90  # of 100 hash classes, those from here on stay as they are
SPM_BELOW = 20  # of 100 hash classes, those below put the suffix first
SEED = "1"


def leads(data: np.ndarray) -> np.ndarray:
    """The bytes that begin a code point."""
    return (data & 0xC0) != 0x80


def unit_starts(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """The bytes that begin a unit; every text's first byte does."""
    if unit == "char":
        return leads(data)
    out = np.zeros(len(data), bool)
    if unit == "word":  # white space belongs to the word before it
        out[K.words(data, offsets)[0]] = True
    elif unit == "line":  # a line holds its line feed
        out[1:] = data[:-1] == 10
    else:
        raise ValueError(f"unknown unit {unit}")
    begin = offsets[:-1][np.diff(offsets) > 0]
    out[begin] = True
    return out


class Fenwick:
    """Cumulative counts of several measures over blocks, found by the first of them."""

    def __init__(self, counts: np.ndarray) -> None:
        """``counts``: one row per block."""
        self.size = len(counts)
        tree = np.zeros((self.size + 1, counts.shape[1]), np.int64)
        tree[1:] = counts
        step = 1
        while step < self.size:  # nodes whose lowest bit is ``step`` add to their parents
            child = np.arange(step, self.size - step + 1, 2 * step)
            tree[child + step] += tree[child]
            step *= 2
        self.tree = tree.tolist()
        self.highest = 1 << (self.size.bit_length() - 1) if self.size else 0

    def totals(self) -> list[int]:
        out, i = [0] * len(self.tree[0]), self.size
        while i:
            out = [a + b for a, b in zip(out, self.tree[i], strict=True)]
            i &= i - 1
        return out

    def descend(self, wanted: int) -> tuple[int, list[int]]:
        """The most blocks whose first measure adds up to ``wanted`` or less, and their sums."""
        at, step, sums = 0, self.highest, [0] * len(self.tree[0])
        while step:
            if at + step <= self.size:
                node = self.tree[at + step]
                if sums[0] + node[0] <= wanted:
                    at += step
                    sums = [a + b for a, b in zip(sums, node, strict=True)]
            step >>= 1
        return at, sums


class Cutter:
    """Byte and code point positions of units in one text."""

    def __init__(self, starts: np.ndarray, lead: np.ndarray, block: int = BLOCK) -> None:
        self.starts, self.lead, self.block = starts, lead, block
        edges = np.arange(0, len(starts), block)
        counts = np.stack([np.add.reduceat(x, edges, dtype=np.int64) for x in (starts, lead)], axis=1) if len(edges) else np.zeros((0, 2), np.int64)
        self.index = Fenwick(counts)
        self.units = self.index.totals()[0]

    def cut(self, units: int) -> tuple[int, int]:
        """``(bytes, code points)`` before unit ``units``; the whole text if it has no more."""
        blocks, (passed, chars) = self.index.descend(units)
        begin = blocks * self.block
        if begin >= len(self.starts):
            return len(self.starts), chars
        here = slice(begin, begin + self.block)
        local = int(np.flatnonzero(self.starts[here])[units - passed])
        return begin + local, chars + int(np.count_nonzero(self.lead[begin : begin + local]))


def fill_in_middle(
    docs: DataFrame,
    key: Column,
    text: Column,
    carry: Sequence[str] = (),
    unit: str = "char",
    marks: tuple[str, str, str] = MARKS,
    plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW,
    seed: str = SEED,
    block: int = BLOCK,
) -> DataFrame:
    """The ``carry`` columns and ``(n, form, prefix_chars, middle_chars, output)``, one row per row of ``docs``.

    The first four 8-digit groups of the hex sha256 of ``seed:key`` are h1 to h4.
    Of n units the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1)
    units, the middle after the larger.  The form is ``plain`` (the text itself)
    for an empty text, one that holds a mark, or h3 % 100 >= ``plain_from``;
    ``spm`` (suffix, prefix, middle) for h4 % 100 < ``spm_below``; else ``psm``.
    ``prefix_chars`` and ``middle_chars`` count code points and are null if plain.

    A null text is an empty one; a null key hashes as an empty string; equal rows
    give equal rows; other columns are ignored; an empty table gives no rows.
    """
    p, s, m = marks
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    text = F.coalesce(text, F.lit(""))
    read = docs.select(*[F.col(c) for c in carry], text.alias("__text"), digest.alias("__digest"))
    h = [F.conv(F.substring("__digest", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    marked = F.contains("__text", F.lit(p)) | F.contains("__text", F.lit(s)) | F.contains("__text", F.lit(m))
    plain = (F.col("__text") == "") | marked | (h[2] % 100 >= plain_from)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    read = read.select(*carry, "__text", h[0].alias("__a"), h[1].alias("__b"), form.alias("__form"))
    kept = len(carry)
    added = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    schema = StructType([*read.schema.fields[:kept], *added])
    before_p, before_s, before_m = (x.encode() for x in marks)

    def transform(batches):
        for batch in batches:
            forms = batch.column(kept + 3).to_pylist()
            one, two = (batch.column(kept + i).to_numpy() for i in (1, 2))
            for i, j, data, offsets in K.chunks(batch.column(kept)):
                lead = leads(data)
                starts = lead if unit == "char" else unit_starts(data, offsets, unit)
                raw = data.tobytes()
                ns, outs, prefixes, middles = [], [], [], []
                for at, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), i):
                    cutter = Cutter(starts[lo:hi], lead[lo:hi], block)
                    n, form = cutter.units, forms[at]
                    ns.append(n)
                    if form == "plain":
                        prefixes.append(None)
                        middles.append(None)
                        outs.append(raw[lo:hi])
                        continue
                    a, b = sorted((int(one[at]) % (n + 1), int(two[at]) % (n + 1)))
                    (cut_a, chars_a), (cut_b, chars_b) = cutter.cut(a), cutter.cut(b)
                    prefixes.append(chars_a)
                    middles.append(chars_b - chars_a)
                    prefix, middle, suffix = raw[lo : lo + cut_a], raw[lo + cut_a : lo + cut_b], raw[lo + cut_b : hi]
                    head = (before_s, suffix, before_p, prefix) if form == "spm" else (before_p, prefix, before_s, suffix)
                    outs.append(b"".join((*head, before_m, middle)))
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in range(kept)],
                        pa.array(ns, pa.int64()),
                        part.column(kept + 3),
                        pa.array(prefixes, pa.int64()),
                        pa.array(middles, pa.int64()),
                        pa.array(outs, pa.binary()).cast(pa.string()),
                    ],
                    names=schema.names,
                )

    return read.mapInArrow(transform, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of.

    No part holds a mark, and a mark's first character occurs in it once, so the
    first place where a mark stands is the one that was put in.
    """
    p, s, m = marks

    def parts(head: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(head) + 1))
        first = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(first) + len(second) + 1)
        middle_part = F.substring_index(rest, m, 1)
        return first, middle_part, F.substr(rest, F.length(middle_part) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    suffix_2, prefix_2, middle_2 = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_2, middle_2, suffix_2)).otherwise(output)


OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), g AS (
  SELECT *, length(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
              WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM g
), p AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""


@register("op11_fill_middle", OP11_SQL)
def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"), ["doc_id"])
    again = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))
