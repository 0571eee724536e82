"""Token ids in binary files with keyed access.

Documents are sorted by key and encoded; runs of them become blocks, and each
task writes its blocks to files of its own, so that file and block numbers follow
the keys.  A block is, in little-endian numbers:

    header    8 x int64: magic, bytes per id, records, records without key, keys, ids, levels, words
    keys      int64 per record, ascending; records without key come first, with 0
    ends      int64 per record: ids up to its end
    sizes     int64 per level: its bits
    words     uint64: the bits of the levels
    ranks     int64 per word: ones before it
    prints    uint32 per key: its fingerprint
    records   uint32 per key: its first record
    payload   the ids, end ids included, in 2 or 4 bytes each

and one line feed that belongs to no block.  ``sizes`` to ``records`` are a
minimal perfect hash of the block's keys: at every level the keys that are left
hash to bits, those alone on theirs set it and are done, and the rank of a key's
bit is its slot.  A lookup tests a bit per level, compares the fingerprint and
slices the payload.

Encoding looks up the distinct words of a run of texts and gives the tokenizer each
distinct word of a worker once, many words in
a call, where the tokenizer's rules allow that, see ``Encoder``.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordering import rank_by_order
from ..session import materialise, new_path
from . import kernels as K
from .registry import register, table

MAGIC = 0x31424B544D4F4C54
END = 0
BLOCK_IDS = 1 << 19  # a block is closed when it holds so many ids
BLOCK_RECORDS = 1 << 14  # or so many records
FILE_BLOCKS = 32  # blocks of a file
GAMMA = 2.0  # bits of a level per key that is left
CACHED = 1 << 19  # words whose ids a worker remembers, twice
LONGEST = 64  # characters of a word that is remembered
TOGETHER = 1000  # words encoded in one call
RUN_CHARS = 1 << 22  # characters of the texts whose distinct words are looked up together
LOOKUP = 1 << 16  # keys looked up in a block together
BROADCAST = 1 << 18  # blocks whose numbers and bounds are sent to all executors at most
STEP = 0x9E3779B97F4A7C15


# encoding


class Words(dict):
    """Ids by word, without the blank before it: the words met last and, in ``old``, those before them."""

    def __init__(self, whole: Callable[[str], bytes]) -> None:
        self.whole = whole
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.whole(" " + word)
        if len(word) <= LONGEST:
            self.learn({word: ids})
        return ids

    def learn(self, pairs: dict[str, bytes]) -> None:
        if len(self) + len(pairs) > CACHED:
            self.old = dict(self)
            self.clear()
        self.update(pairs)


class Encoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library, without special tokens.

    A tokenizer that only splits at byte level, by its own pattern and without a
    normalizer, never joins a character with white space after it: text is cut
    there, at blanks, and a word with the blank before it is encoded once.  New
    words are encoded in one call as a text of their own, whose ids are dealt to
    them by the bytes that ids stand for.  Any other tokenizer gets whole texts.
    """

    RUN = re.compile(r"\s ")  # a blank that white space stands before is no place to cut
    CUT = re.compile(r"(?<=\S) ")

    def __init__(self, path: str, width: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width, self.letter = width, {2: "H", 4: "I"}[width]
        self.by_word = splits_at_blanks(self.tokenizer)
        self.words = Words(self.whole)
        self.sizes = id_bytes(self.tokenizer) if self.by_word else None

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def __call__(self, text: str) -> bytes:
        return self.several([text])[0]

    def several(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.whole(text) if text else b"" for text in texts]
        column = pa.array(texts, pa.large_string())
        cut = pc.split_pattern(column, " ")
        if any(map(self.RUN.search, texts)):
            cut = pa.array([self.CUT.split(text) if self.RUN.search(text) else words for text, words in zip(texts, cut.to_pylist(), strict=True)], pa.large_list(pa.large_string()))
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        met = cut.flatten().dictionary_encode()
        at = met.indices.to_numpy().astype(np.int64)
        ids = self._known(met.dictionary.to_numpy(zero_copy_only=False).tolist())
        # the first word of a text has no blank before it
        names = met.dictionary.take(pa.array(at[first[:-1]])).to_pylist()
        at[first[:-1]] = len(ids) + np.arange(len(texts))
        ids += [self.whole(word) if word else b"" for word in names]
        return _dealt(ids, at, first, self.width)

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words with a blank before each."""
        found = list(map(self.words.get, words))
        missed = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not missed:
            return found
        self._prepare(missed)
        rest = map(self.words.__getitem__, missed)
        return [next(rest) if ids is None else ids for ids in found]

    def _prepare(self, words: list[str]) -> None:
        """Encode the words that are not remembered, but for those that a blank after them could be joined with."""
        if self.sizes is None:
            return
        old, most = self.words.old, min(TOGETHER, CACHED)
        met = {w: old[w] for w in words if w in old}
        new = [w for w in words if w not in met and len(w) <= LONGEST and not w[-1:].isspace() and w]
        if met:
            self.words.learn(met)
        for at in range(0, len(new), most):
            some = new[at : at + most]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            stops = np.cumsum(1 + pc.binary_length(pa.array(some, pa.string())).to_numpy())
            ends = np.cumsum(self.sizes[ids])
            last = np.searchsorted(ends, stops)
            if len(ids) <= last[-1] or (ends[last] != stops).any():
                return  # an id does not stand for its bytes: each word is encoded by itself
            data, places = ids.tobytes(), ((last + 1) * self.width).tolist()
            self.words.learn(dict(zip(some, [data[i:j] for i, j in zip([0, *places[:-1]], places, strict=True)], strict=True)))


def _dealt(ids: list[bytes], at: np.ndarray, first: np.ndarray, width: int) -> list[bytes]:
    """For each text the ids of its words; ``at``: the words' numbers, ``first``: the first word of each text and the end."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
    begin = np.cumsum(sizes) - sizes
    n = sizes[at]
    upto = np.concatenate([[0], np.cumsum(n)])
    source = np.repeat(begin[at] - upto[:-1], n) + np.arange(upto[-1])
    data = np.frombuffer(b"".join(ids), f"<u{width}")[source].tobytes()
    ends = (upto[first] * width).tolist()
    return [data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def id_bytes(tokenizer) -> np.ndarray | None:
    """How many bytes of a text each id stands for; None where a byte may have no id."""
    from tokenizers.pre_tokenizers import ByteLevel

    vocab = tokenizer.get_vocab()
    if not all(c in vocab for c in ByteLevel.alphabet()):
        return None
    added = {i: len(t.content.encode()) for i, t in tokenizer.get_added_tokens_decoder().items()}
    sizes = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        sizes[i] = added.get(i, len(token))
    return sizes


def splits_at_blanks(tokenizer) -> bool:
    rules = json.loads(tokenizer.to_str())
    before = rules["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in rules["added_tokens"])
    return bool(plain and added and rules["normalizer"] is None and rules["post_processor"] is None and not rules["truncation"] and not rules["padding"])


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    """One encoder per worker process; what it remembers outlives a task."""
    if (path, width) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def id_width(path: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab().values(), default=0) < 1 << 16 > end_id else 4


# minimal perfect hash


def bits_of(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64(STEP * (level + 1) % (1 << 64))
    return (K.mix64(keys + salt) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (K.mix64(keys ^ np.uint64(STEP)) >> np.uint64(32)).astype(np.uint32)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sizes, words, ranks)`` for distinct uint64 keys."""
    sizes, words, left = [], [], keys
    while len(left):
        size = -(-int(GAMMA * len(left)) // 64) * 64
        at = bits_of(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size)
        left = left[~alone[at]]
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    ones = np.bitwise_count(flat).astype(np.int64)
    return np.array(sizes, np.int64), flat, np.cumsum(ones) - ones


def slots(keys: np.ndarray, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The slot of each key; a key that was not built in gets any slot or -1."""
    out = np.full(len(keys), -1, np.int64)
    left = np.arange(len(keys))
    first = 0
    for level, size in enumerate(sizes.tolist()):
        at = bits_of(keys[left], level, size)
        word, bit = first + (at >> 6), (at & 63).astype(np.uint64)
        found = (words[word] >> bit) & np.uint64(1) == 1
        below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        out[left[found]] = (ranks[word] + np.bitwise_count(below))[found]
        left = left[~found]
        first += size >> 6
    return out


# blocks


def write_block(keys: list[int | None], texts: list[bytes], width: int) -> bytes:
    """One block; ``keys`` ascend and start with the null ones, ``texts`` are the records' ids."""
    nulls = sum(k is None for k in keys)
    key = np.array([k or 0 for k in keys], np.int64)
    ends = np.cumsum([len(t) // width for t in texts], dtype=np.int64)
    named = key[nulls:]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(named)), bool), named[1:] != named[:-1]]))
    distinct = named[first].view(np.uint64)
    sizes, words, ranks = build_hash(distinct)
    slot = slots(distinct, sizes, words, ranks)
    prints, records = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    prints[slot] = fingerprints(distinct)
    records[slot] = nulls + first
    header = np.array([MAGIC, width, len(keys), nulls, len(distinct), ends[-1] if len(ends) else 0, len(sizes), len(words)], "<i8")
    return b"".join([header.tobytes(), key.tobytes(), ends.tobytes(), sizes.tobytes(), words.tobytes(), ranks.tobytes(), prints.tobytes(), records.tobytes(), *texts])


class Block:
    """A block at a place of a file's bytes; arrays are views."""

    def __init__(self, data, at: int) -> None:
        self.data = data
        magic, self.width, self.n, self.nulls, n_keys, self.n_ids, levels, words = self._read("<i8", at, 8).tolist()
        if magic != MAGIC:
            raise ValueError("no block of token ids")
        at += 64
        parts = []
        for kind, count in (("<i8", self.n), ("<i8", self.n), ("<i8", levels), ("<u8", words), ("<i8", words), ("<u4", n_keys), ("<u4", n_keys)):
            parts.append(self._read(kind, at, count))
            at += count * int(kind[2])
        self.keys, self.ends, self.sizes, self.words, self.ranks, self.prints, self.records = parts
        self.payload = at
        self.end = at + self.n_ids * self.width + 1

    def _read(self, kind: str, at: int, count: int) -> np.ndarray:
        return np.frombuffer(self.data, kind, count, at)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first record of each key, -1 for keys that the block does not hold."""
        asked = keys.astype(np.int64).view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        slot = slots(asked, self.sizes, self.words, self.ranks)
        hit = np.flatnonzero(slot >= 0)
        hit = hit[self.prints[slot[hit]] == fingerprints(asked[hit])]
        record = self.records[slot[hit]].astype(np.int64)
        same = self.keys[record] == keys[hit]  # fingerprints of other keys may agree
        out[hit[same]] = record[same]
        return out

    def same_key(self, record: int) -> range:
        """The records that share the key of the first of them."""
        return range(record, int(np.searchsorted(self.keys[self.nulls :], self.keys[record], "right")) + self.nulls)

    def ids(self, record: int) -> np.ndarray:
        """The ids of a record, its end id included, as uint32."""
        begin = int(self.ends[record - 1]) if record else 0
        return self._read(f"<u{self.width}", self.payload + begin * self.width, int(self.ends[record]) - begin).astype("<u4")


def blocks_of(data) -> Iterator[Block]:
    at = 0
    while at < len(data):
        block = Block(data, at)
        yield block
        at = block.end


# files


def runs(batches) -> Iterator[list[tuple[int | None, str]]]:
    """The rows in order, in lists of about ``RUN_CHARS`` characters."""
    held, size = [], 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            held.append((key.as_py(), text.as_py()))
            size += len(held[-1][1])
            if size >= RUN_CHARS or len(held) >= BLOCK_RECORDS:
                yield held
                held, size = [], 0
    if held:
        yield held


def write_tokens(
    docs: DataFrame, doc_id: str, text: str, path: str, tokenizer: str, end_id: int = END, block_ids: int = BLOCK_IDS, block_records: int = BLOCK_RECORDS, file_blocks: int = FILE_BLOCKS
) -> None:
    """Write the ids of all texts, ``end_id`` after each, to files under ``path`` in ascending order of ``doc_id``.

    A null or empty text is its end id alone; rows without id come first; rows of
    equal id follow each other in the order of a hash of their texts, equal rows
    are records of their own; other columns are ignored; an empty table writes no
    block.  ``tokenizer`` names a file that every executor has.
    """
    width = id_width(tokenizer, end_id)
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    # the range is cut by id and hash, so rows of one id may be many; their texts settle the order within a task
    ordered = read.repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def encode(batches):
        encoding = encoder(tokenizer, width)
        end = np.array([end_id], f"<u{width}").tobytes()
        keys, texts, held = [], [], 0
        for run in runs(batches):
            for (key, _), ids in zip(run, encoding.several([text for _, text in run]), strict=True):
                ids += end
                keys.append(key)
                texts.append(ids)
                held += len(ids) // width
                if held >= block_ids or len(keys) >= block_records:
                    yield pa.RecordBatch.from_arrays([pa.array([write_block(keys, texts, width)], pa.binary())], names=["block"])
                    keys, texts, held = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([write_block(keys, texts, width)], pa.binary())], names=["block"])

    # the text sink writes a value's bytes as they are, and each task's files under its number
    blocks = ordered.mapInArrow(encode, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.mode("errorifexists").option("compression", "none").option("lineSep", "\n").option("maxRecordsPerFile", file_blocks).text(path)


PLACE = "part int, file int, block int"
NAME = re.compile(r"part-(\d+)-[^/]*-c(\d+)[^/]*$")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(part, file, block, record, start, doc_id, n_tokens, ids)`` of every record, ``ids`` as little-endian uint32.

    ``start`` counts the ids before it in its block.  Every key is looked up in
    its block's index.
    """

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, file = map(int, NAME.search(name).groups())
                for number, block in enumerate(blocks_of(content.as_buffer())):
                    record = np.arange(block.n)
                    first = block.find(block.keys[block.nulls :])
                    if (first < 0).any():
                        raise ValueError(f"{name}, block {number}: a key is not found")
                    run = np.arange(block.n - block.nulls) - np.searchsorted(block.keys[block.nulls :], block.keys[block.nulls :])
                    record[block.nulls :] = first + run
                    begin = np.concatenate([[0], block.ends[:-1]])[record] if block.n else record
                    named = np.arange(block.n) >= block.nulls
                    constant = [pa.array(np.full(block.n, x, np.int32)) for x in (part, file, number)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *constant,
                            pa.array(record),
                            pa.array(begin),
                            pa.array(block.keys, mask=~named),
                            pa.array(block.ends[record] - begin),
                            pa.array([block.ids(r).tobytes() for r in record.tolist()], pa.binary()),
                        ],
                        names=["part", "file", "block", "record", "start", "doc_id", "n_tokens", "ids"],
                    )

    return read_files(spark, path).mapInArrow(read, f"{PLACE}, record long, start long, doc_id long, n_tokens long, ids binary")


def with_start(records: DataFrame) -> DataFrame:
    """``start`` counted over all files instead of the record's block."""
    place = ["part", "file", "block"]
    totals = records.groupBy(*place).agg(F.sum("n_tokens").alias("__n"))
    totals = rank_by_order(totals, [], place, rank=None, amount="__n", running="__upto")
    totals = totals.select(*place, (F.col("__upto") - F.col("__n")).alias("__before"))
    return records.join(totals, place).withColumn("start", F.col("start") + F.col("__before")).drop("__before")


def block_bounds(spark: SparkSession, path: str) -> DataFrame:
    """``(part, file, block, lo, hi)``: the least and greatest key of each block that has one."""

    def read(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, file = map(int, NAME.search(name).groups())
                for number, b in enumerate(blocks_of(content.as_buffer())):
                    if b.n > b.nulls:
                        out.append((part, file, number, int(b.keys[b.nulls]), int(b.keys[-1])))
            kinds = [pa.int32()] * 3 + [pa.int64()] * 2
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "file", "block", "lo", "hi"])

    return read_files(spark, path).mapInArrow(read, f"{PLACE}, lo long, hi long")


def routed(keys: DataFrame, bounds: DataFrame) -> DataFrame:
    """``(doc_id, part, file, block)``: the blocks whose bounds hold each key.

    Blocks ascend, so those that begin at the key are found by equality and the
    one that may hold its first records is the last that begins before it.
    """
    if bounds.limit(BROADCAST + 1).count() <= BROADCAST:
        return keys.join(F.broadcast(bounds), (F.col("doc_id") >= F.col("lo")) & (F.col("doc_id") <= F.col("hi"))).select("doc_id", "part", "file", "block")
    place = F.struct("part", "file", "block")
    equal = keys.join(bounds, F.col("doc_id") == F.col("lo")).select("doc_id", "part", "file", "block")
    asked = keys.select("doc_id", F.lit(None).cast("struct<hi:bigint,place:struct<part:int,file:int,block:int>>").alias("b"))
    # a block stands after a key that equals its least one, so that a key sees the blocks that begin before it only
    line = asked.unionByName(bounds.select(F.col("lo").alias("doc_id"), F.struct("hi", place.alias("place")).alias("b")))
    order = [F.col("doc_id"), F.col("b").isNotNull(), F.col("b.place")]
    line = line.repartitionByRange(*order)
    line = materialise(line.withColumn("slice", F.spark_partition_id()), "routes")
    last = line.filter("b is not null").groupBy("slice").agg(F.max_by("b", F.struct("doc_id", "b.place")).alias("b"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    slices = line.select("slice").distinct().join(last, "slice", "left").select("slice", F.last("b", True).over(earlier).alias("carried"))
    within = Window.partitionBy("slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("seen", F.last("b", True).over(within)).filter("b is null").drop("b").join(slices, "slice")
    seen = seen.withColumn("seen", F.coalesce("seen", "carried")).filter("seen.hi >= doc_id")
    return equal.unionByName(seen.select("doc_id", "seen.place.part", "seen.place.file", "seen.place.block"))


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame:
    """``(doc_id, record, ids)`` of every record of the asked keys; keys that no file holds, and null, give no row.

    A key is routed to its block by the blocks' bounds and found there by the
    perfect hash; keys of one block are asked together, LOOKUP at a time.
    """
    asked = keys.select(F.col(key).cast("bigint").alias("doc_id")).filter("doc_id is not null").distinct()
    place = ["part", "file", "block"]
    at = routed(asked, materialise(block_bounds(spark, path), "bounds"))
    nth = F.row_number().over(Window.partitionBy(*place).orderBy("doc_id"))
    at = at.withColumn("turn", F.floor((nth - 1) / LOOKUP)).groupBy(*place, "turn").agg(F.collect_list("doc_id").alias("keys"))

    def cut(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, file = map(int, NAME.search(name).groups())
                data = content.as_buffer()
                begin = 0
                for number, b in enumerate(blocks_of(data)):
                    columns = [pa.array([x], pa.int32()) for x in (part, file, number)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([data.slice(begin, b.end - begin).to_pybytes()], pa.binary())], names=[*place, "content"])
                    begin = b.end

    def find(batches):
        for batch in batches:
            for asked, content in zip(batch.column(0), batch.column(1), strict=True):
                block = Block(content.as_buffer(), 0)
                asked = asked.values.to_numpy()
                record = block.find(asked)
                hits = [(k, i) for k, r in zip(asked.tolist(), record.tolist(), strict=True) if r >= 0 for i in block.same_key(r)]
                columns = [pa.array([k for k, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64()), pa.array([block.ids(i).tobytes() for _, i in hits], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "record", "ids"])

    blocks = read_files(spark, path).mapInArrow(cut, f"{PLACE}, content binary")
    return blocks.join(at, place).select("keys", "content").mapInArrow(find, "doc_id long, record long, ids binary")


@register("op13_token_files")
def op13_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token_files")
    write_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", path, public_tokenizers.path("byte_bpe_50k.json"))
    read = read_tokens(spark, path).select("part", "file", "block", "start", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_start(materialise(read, "token_records")).select("doc_id", "start", "n_tokens", "ids_crc32")
