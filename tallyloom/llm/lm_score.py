"""LM scoring: cross-entropy difference of two matched bigram models.

The target model counts the documents of a target set, the background model all
documents.  Both share one vocabulary (every word that occurs ``LEAST`` times,
the rest being one unknown word), one set of bigrams (likewise) and one
smoothing, so that a difference comes from the texts alone.

A word's loss is the sum of three terms: of the word, of its context, and of the
bigram if that is kept.  The terms are a table; the words and bigrams of each text
are counted and joined to it by key, so neither model has to fit one process.
Only terms of the most frequent words and bigrams, at most 1 / ``HEAD`` of each, are
sent to all executors, which saves rows of the join and changes no score.

A document's score is its mean loss per word under the target model minus that
under the background model: the lower, the more it is like the target set.
Hashes of 64 bits stand for words, bigrams and texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, scratch
from . import kernels as K
from .registry import register, table

SHARE = 0.0  # of all words, that a kept word or bigram has at least
LEAST = 2  # occurrences that a kept word or bigram has at least
DISCOUNT = 0.75  # of every kept bigram count, given to the unigram model
ADDED = 0.5  # to every word count
HEAD = 2e-6  # of all words: the terms of words and bigrams as frequent are sent to all executors
BLOCK = 500_000  # words counted together
SLICE = 1 << 16  # rows handed on together
BROADCAST = 1_000_000  # ids that are sent to all executors at most
NONE, UNKNOWN, START = 0, 1, 2  # in place of a word's hash: no context, a word out of the vocabulary, the start of a text
WORD, PAIR = -1, -2  # kinds of a text's rows; from 0 on, the row of the text itself with its number of words


def word_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, word hashes, first word of each text)``, block by block; A-Z in lower case."""
    for i, _, data, offsets in K.chunks(column):
        data = K.LOWER[data]
        start, stop, first = K.words(data, offsets)
        yield i, K.word_hashes(data, start, stop), first


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return K.mix64(before * np.uint64(K.BASE) + word)


def contexts(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word, ``START`` at the start of a text; whether a word is the last of its text."""
    filled = first[1:] > first[:-1]
    before, last = np.empty_like(hashes), np.zeros(len(hashes), bool)
    before[1:] = hashes[:-1]
    before[first[:-1][filled]] = START
    last[first[1:][filled] - 1] = True
    return before, last


def _sliced(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns as batches; hashes as signed numbers."""
    arrays = [pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for v in columns.values()]
    whole = pa.RecordBatch.from_arrays(arrays, names=list(columns))
    for at in range(0, whole.num_rows, SLICE):
        yield whole.slice(at, SLICE)


def _blocks(batches, flagged: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(words, contexts, last of its text, target)`` of about ``BLOCK`` words each."""
    held, size = [], 0
    for batch in batches:
        target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool) if flagged else np.zeros(batch.num_rows, bool)
        for i, hashes, first in word_rows(batch.column(0)):
            held.append((hashes, *contexts(hashes, first), np.repeat(target[i : i + len(first) - 1], np.diff(first))))
            size += len(hashes)
            if size > BLOCK:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def word_counts(flagged: DataFrame) -> DataFrame:
    """``(word, n, n_target, m, m_target)``: occurrences, and those as a context."""

    def count(batches):
        for hashes, _, last, target in _blocks(batches, True):
            word, at = np.unique(hashes, return_inverse=True)
            n, n_target, m, m_target = (np.bincount(at[x], minlength=len(word)) for x in (slice(None), target, ~last, target & ~last))
            yield from _sliced({"word": word, "n": n, "n_target": n_target, "m": m, "m_target": m_target})

    rows = flagged.select("text", "target").mapInArrow(count, "word long, n long, n_target long, m long, m_target long")
    return rows.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "n_target", "m", "m_target")])


def pair_counts(flagged: DataFrame) -> DataFrame:
    """``(before, word, n, n_target)`` of the words as they stand, in parts."""

    def count(batches):
        for hashes, before, _, target in _blocks(batches, True):
            _, head, at = np.unique(pair_keys(before, hashes), return_index=True, return_inverse=True)
            n, n_target = np.bincount(at, minlength=len(head)), np.bincount(at[target], minlength=len(head))
            yield from _sliced({"before": before[head], "word": hashes[head], "n": n, "n_target": n_target})

    return flagged.select("text", "target").mapInArrow(count, "before long, word long, n long, n_target long")


def unknown_pairs(flagged: DataFrame, known: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``(text, before, word, n, n_target)``: each text's bigrams with a word out of the vocabulary, ``UNKNOWN`` in its place.

    ``text`` is the text's hash.  ``frequent``: sorted hashes of some known words, which need no look at the table.
    """
    shared = flagged.sparkSession.sparkContext.broadcast(frequent)

    def rare(batches):
        for batch in batches:
            text, target = batch.column(2).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, hashes, first in word_rows(batch.column(0)):
                before, last = contexts(hashes, first)
                after = np.append(hashes[1:], np.zeros(min(1, len(hashes)), np.uint64))
                after[last] = NONE
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                at = np.flatnonzero(~found(shared.value, hashes)[0])
                doc = owner[at]
                yield from _sliced({"word": hashes[at], "text": text[i + doc], "i": at - first[doc], "before": before[at], "after": after[at], "target": target[i + doc]})

    rows = flagged.select("text", "target", F.xxhash64("text")).mapInArrow(rare, "word long, text long, i long, before long, after long, target long")
    rows = rows.join(known.select("word"), "word", "left_anti")
    one, none, unknown = F.lit(1), F.lit(0), F.lit(UNKNOWN).cast("bigint")
    own = F.struct(F.col("i").alias("i"), F.col("before").alias("b"), unknown.alias("w"), none.alias("b_gone"), one.alias("w_gone"))
    following = F.struct((F.col("i") + 1).alias("i"), unknown.alias("b"), F.col("after").alias("w"), one.alias("b_gone"), none.alias("w_gone"))
    both = F.when(F.col("after") == NONE, F.array(own)).otherwise(F.array(own, following))
    rows = rows.select("text", "target", F.explode(both).alias("p")).select("text", "target", "p.*")
    met = rows.groupBy("text", "i").agg(  # equal texts have equal places
        F.sum("b_gone").alias("b_gone"), F.sum("w_gone").alias("w_gone"),
        F.max(F.when(F.col("b_gone") == 0, F.col("b"))).alias("b"), F.max(F.when(F.col("w_gone") == 0, F.col("w"))).alias("w"),
        F.sum(F.col("b_gone") * F.col("target")).alias("b_target"), F.sum(F.col("w_gone") * F.col("target")).alias("w_target"),
    )
    named = met.select(
        "text", F.when(F.col("b_gone") > 0, unknown).otherwise(F.col("b")).alias("before"), F.when(F.col("w_gone") > 0, unknown).otherwise(F.col("w")).alias("word"),
        F.greatest("b_gone", "w_gone").alias("n"), F.greatest("b_target", "w_target").alias("n_target"),
    )
    return materialise(named.groupBy("text", "before", "word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")), "unknown")


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which are among the sorted keys, and the place of each."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


@dataclass
class Models:
    """The terms of both models over one vocabulary; of each pair of terms, the first is the target's."""

    terms: DataFrame  # before, word, n, x_target, x, y_target, y: of a word (before is NONE) and as a context, or of a bigram and 0
    known: DataFrame  # word
    frequent: np.ndarray  # sorted hashes of words
    words: tuple[np.ndarray, np.ndarray]  # sorted hashes of frequent words, [4, words]: their terms
    pairs: tuple[np.ndarray, np.ndarray]  # sorted keys of frequent bigrams, likewise
    unknown: list[float]  # terms of the unknown word
    start: list[float]  # terms of the start of a text
    gone: DataFrame  # text, before, word, n: the trained texts' bigrams with a word out of the vocabulary


def train(
    texts: DataFrame, flagged: DataFrame, share: float = SHARE, least: int = LEAST, discount: float = DISCOUNT, added: float = ADDED, head: float = HEAD
) -> Models:
    """Both models from ``(text, target)`` rows; ``texts`` has the same rows without the mark."""
    counts = materialise(word_counts(flagged), "words")
    names = ("n", "n_target", "m", "m_target")
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    limit = max(least, share * total.n)
    often = max(limit, head * total.n)
    known = counts.filter(F.col("n") >= limit)
    sums = known.agg(F.count(F.lit(1)).alias("size"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    frequent = np.sort(known.filter(F.col("n") >= often).select("word").toArrow()["word"].to_numpy().view(np.uint64))

    gone = unknown_pairs(flagged, known, frequent)
    pairs = pair_counts(flagged).unionByName(gone.select("before", "word", "n", "n_target")).groupBy("before", "word").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))
    pairs = materialise(pairs.filter(F.col("n") >= limit), "bigrams")  # as they stand, only bigrams of known words are as frequent

    def less(column: str) -> Column:
        return F.greatest(F.col(column) - F.lit(discount), F.lit(0.0))

    spark = flagged.sparkSession
    others = [(UNKNOWN, *[total[c] - sums[c] for c in names]), (START, 0, 0, total.n - total.m, total.n_target - total.m_target)]
    words = known.unionByName(spark.createDataFrame(others, known.schema))
    held = pairs.groupBy(F.col("before").alias("word")).agg(F.sum(less("n")).alias("h"), F.sum(less("n_target")).alias("h_target"))
    words = words.join(held, "word", "left")

    def rest(m: str, h: str) -> Column:
        return -F.log(F.greatest(1 - F.when(F.col(m) > 0, F.coalesce(h, F.lit(0.0)) / F.col(m)).otherwise(0.0), F.lit(1e-12)))

    def unigram(n: str) -> Column:
        return -F.log((F.col(n) + added) / (total[n] + added * (sums["size"] + 1)))

    words = materialise(
        words.select(
            "word", "n", "m", "m_target",
            unigram("n_target").alias("x_target"), unigram("n").alias("x"), rest("m_target", "h_target").alias("y_target"), rest("m", "h").alias("y"),
        ),
        "word_terms",
    )
    after = words.select(F.col("word").alias("before"), "m", "m_target", "y_target", "y")
    pairs = pairs.join(after, "before").join(words.select("word", "x_target", "x"), "word")

    def gain(n: str, m: str, x: str, y: str) -> Column:
        return -F.log1p(F.when(F.col(m) > 0, less(n) / F.col(m)).otherwise(0.0) * F.exp(F.col(x) + F.col(y)))

    none = F.lit(0.0)
    pairs = pairs.select("before", "word", "n", gain("n_target", "m_target", "x_target", "y_target").alias("x_target"), gain("n", "m", "x", "y").alias("x"), none.alias("y_target"), none.alias("y"))
    own = words.select(F.lit(NONE).cast("bigint").alias("before"), "word", "n", "x_target", "x", "y_target", "y")
    terms = materialise(own.unionByName(pairs), "terms")

    def arrays(rows: DataFrame, single: bool) -> tuple[np.ndarray, np.ndarray]:
        got = rows.filter((F.col("n") >= often) & ~F.col("word").isin(START) & ((F.col("before") == NONE) == F.lit(single))).toArrow()
        before, word = (got[c].to_numpy().view(np.uint64) for c in ("before", "word"))
        keys = word if single else pair_keys(before, word)
        order = np.argsort(keys)
        return keys[order], np.array([got[c].to_numpy()[order] for c in ("x_target", "x", "y_target", "y")]).reshape(4, -1)

    special = {r.word: [r.x_target, r.x, r.y_target, r.y] for r in words.filter(F.col("word").isin(UNKNOWN, START)).collect()}
    return Models(terms, known.select("word"), frequent, arrays(terms, True), arrays(terms, False), special[UNKNOWN], special[START], gone.select("text", "before", "word", "n"))


def text_rows(docs: DataFrame, models: Models) -> DataFrame:
    """``(text, before, word, kind, x, y)`` of ``(text)`` rows: how often each text has a word, the word as a context, and a bigram.

    The terms of what is frequent are summed at once, in the row of the text itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast((models.words, models.pairs, models.start))

    def rows(batches):
        (words, word_terms), (pairs, pair_terms), start = shared.value
        for batch in batches:
            text = batch.column(1).to_numpy()
            for i, hashes, first in word_rows(batch.column(0)):
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)
                before, last = contexts(hashes, first)
                keys = pair_keys(before, hashes)
                seen, at = found(words, hashes)
                both, pair_at = found(pairs, keys)
                sums = []
                for k in (0, 1):
                    loss = np.zeros(len(hashes))
                    loss[seen] = word_terms[k, at[seen]] + np.where(last[seen], 0.0, word_terms[k + 2, at[seen]])
                    loss[both] += pair_terms[k, pair_at[both]]
                    sums.append(np.bincount(doc, weights=loss, minlength=len(n)) + np.where(n > 0, start[k + 2], 0.0))
                zeros = np.zeros(len(n), np.uint64)
                yield from _sliced({"text": text[i : i + len(n)], "before": zeros, "word": zeros, "kind": n.astype(np.int64), "x": sums[0], "y": sums[1]})
                for kind, left, value in ((WORD, ~seen, hashes), (PAIR, ~both, keys)):
                    left = np.flatnonzero(left)
                    left = left[np.lexsort((value[left], doc[left]))]
                    new = np.ones(len(left), bool)
                    new[1:] = (doc[left][1:] != doc[left][:-1]) | (value[left][1:] != value[left][:-1])
                    group, one = np.cumsum(new) - 1, left[new]
                    x = np.bincount(group, minlength=len(one)).astype(float)
                    y = np.bincount(group, weights=~last[left], minlength=len(one))
                    if kind == PAIR:
                        y[:] = 0
                    yield from _sliced(
                        {"text": text[i + doc[one]], "before": before[one] if kind == PAIR else np.zeros(len(one), np.uint64), "word": hashes[one], "kind": np.full(len(one), kind), "x": x, "y": y}
                    )

    return docs.select("text", F.xxhash64("text")).mapInArrow(rows, "text long, before long, word long, kind long, x double, y double")


def scored(docs: DataFrame, doc_id: str, text: str, models: Models, gone: DataFrame | None = None) -> DataFrame:
    """``(doc_id, n_words, target_loss, background_loss, difference)``, one row per row of ``docs``.

    Losses are means per word in nats.  A null or empty text has 0 words and null
    losses; equal texts have equal losses; other columns are ignored; an empty
    table gives no rows.  ``gone`` is the models' own where they were trained on
    these rows.
    """
    texts = docs.select(F.col(text).alias("text"))
    if gone is None:
        gone = unknown_pairs(texts.withColumn("target", F.lit(False)), models.known, models.frequent)
    gone = gone.select("text", "before", "word", F.lit(PAIR).cast("bigint").alias("kind"), F.col("n").cast("double").alias("x"), F.lit(0.0).alias("y"))
    kind, key = F.col("kind"), F.xxhash64("before", "word")
    rows = text_rows(texts, models).unionByName(gone)
    rows = rows.select("text", "kind", F.col("x").alias("a"), F.col("y").alias("b"), F.when(kind >= 0, F.col("text")).otherwise(key).alias("key"))
    terms = models.terms.select(key.alias("key"), "x_target", "x", "y_target", "y")
    joined = rows.join(terms, "key", "left")

    def loss(own: str, k: int, x: str, y: str) -> Column:
        word = F.col("a") * F.coalesce(x, F.lit(models.unknown[k])) + F.col("b") * F.coalesce(y, F.lit(models.unknown[k + 2]))
        return F.sum(F.when(kind >= 0, F.col(own)).when(kind == WORD, word).otherwise(F.col("a") * F.coalesce(x, F.lit(0.0))))

    itself = kind >= 0
    sums = joined.groupBy("text").agg(
        F.max(F.when(itself, kind)).alias("n_words"), F.sum(F.when(itself, kind)).alias("words"),
        loss("a", 0, "x_target", "y_target").alias("target_loss"), loss("b", 1, "x", "y").alias("background_loss"),
    )
    means = sums.select("text", "n_words", *[F.when(F.col("words") > 0, F.col(c) / F.col("words")).alias(c) for c in ("target_loss", "background_loss")])
    means = materialise(means, "losses")
    read = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("text"))
    return read.join(means, "text", "left").select("doc_id", "n_words", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("difference"))


def flagged(docs: DataFrame, doc_id: str, text: str, chosen: DataFrame, chosen_id: str) -> DataFrame:
    """``(text, target)``: whether the document's id is among the chosen ones."""
    ids = chosen.select(F.col(chosen_id).cast("bigint").alias("__id")).filter("__id is not null").distinct()
    ids = materialise(ids, "chosen")
    if ids.count() <= BROADCAST:  # else both sides are shuffled
        ids = F.broadcast(ids)
    joined = docs.select(F.col(doc_id).cast("bigint").alias("__d"), F.col(text).alias("text")).join(ids, F.col("__d") == F.col("__id"), "left")
    return joined.select("text", F.col("__id").isNotNull().alias("target"))


@register("op2_lm_difference")
def op2_lm_difference(spark, sf_dir: str) -> DataFrame:
    """Documents against a model of those labelled as good."""
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    with scratch(spark) as keep:
        models = train(docs.select("text"), flagged(docs, "doc_id", "text", good, "doc_id"))
        return keep(scored(docs, "doc_id", "text", models, models.gone), "scores")
