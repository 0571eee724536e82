"""Vocabulary and phrase filters over n-gram tables ``(words, ...)``.

Sentence sets are kept as (block, 62-bit mask) pairs: one row stands for up to
62 sentences, and the sets of an n-gram's words are intersected by a partially
combined ``bit_and`` instead of by listing word x sentence pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import BOS, EOS, context_of
from ..session import materialise

BLOCK = 62


def is_tag(word: Column) -> Column:
    return word.startswith("<") & word.endswith(">")


def plain_words(text: Column) -> Column:
    """Distinct words of an n-gram without ``<...>`` tags."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: (w != "") & ~is_tag(w)))


def filter_single(ngrams: DataFrame, vocab: DataFrame, text: Column | None = None) -> DataFrame:
    """Keep n-grams whose non-tag words are all in ``vocab(word)``.

    A join per place of a word: what fails at one place is gone at the next, and
    n-grams are not moved at all where the vocabulary is small.
    """
    text = F.col("words") if text is None else text
    left = ngrams.withColumn("__ws", plain_words(text))
    longest = left.agg(F.max(F.size("__ws"))).first()[0] or 0
    known = materialise(vocab.select("word").distinct(), "vocab")  # written, so that its size is known
    for i in range(longest):
        listed = known.select(F.col("word").alias("__w"), F.lit(True).alias("__known"))
        left = left.withColumn("__w", F.get("__ws", F.lit(i))).join(listed, "__w", "left").filter(F.col("__w").isNull() | F.col("__known")).drop("__w", "__known")
    return left.select(ngrams.columns)


def _masks(sets: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, sent_id)`` rows to ``(keys, block, mask)``."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(sent_id, {BLOCK}) as int))")
    block = F.expr(f"sent_id div {BLOCK}")
    return sets.groupBy(*keys, block.alias("block")).agg(F.bit_or(bit).alias("mask"))


def _explode_masks(rows: DataFrame) -> DataFrame:
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != 0
    )
    return rows.select("words", F.explode(bits).alias("__bit"), "block").select(
        "words", (F.col("block") * BLOCK + F.col("__bit")).cast("bigint").alias("sent_id")
    )


def _common(parts: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks whose sentences hold every part of a candidate.

    ``parts(words, variant, n, <keys>)``; returns ``(words, block, mask)``.
    """
    hits = parts.join(_masks(sets, keys), keys)
    whole = hits.groupBy("words", "variant", "n", "block").agg(
        F.bit_and("mask").alias("mask"), F.count(F.lit(1)).alias("__c")
    )
    return whole.filter((F.col("__c") == F.col("n")) & (F.col("mask") != 0)).groupBy("words", "block").agg(
        F.bit_or("mask").alias("mask")
    )


def _word_parts(ngrams: DataFrame, sent_vocab: DataFrame, text: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    # a word in no sentence at all rules the n-gram out before the set join
    able = materialise(filter_single(ngrams, sent_vocab, text), "able")
    listed = able.select("words", plain_words(text).alias("__ws"))
    free = listed.filter(F.size("__ws") == 0).select("words")
    parts = listed.filter(F.size("__ws") > 0).select("words", F.lit(0).alias("variant"), F.size("__ws").alias("n"), F.explode("__ws").alias("word"))
    return able, parts, free


def filter_union(ngrams: DataFrame, sent_vocab: DataFrame, text: Column | None = None) -> DataFrame:
    """Keep n-grams if one sentence of ``sent_vocab(sent_id, word)`` holds all words."""
    text = F.col("words") if text is None else text
    able, parts, free = _word_parts(ngrams, sent_vocab, text)
    good = _common(parts, sent_vocab, ["word"]).select("words").distinct()
    return able.join(good.unionByName(free), "words", "left_semi")


def filter_multiple(ngrams: DataFrame, sent_vocab: DataFrame, text: Column | None = None) -> DataFrame:
    """``(sent_id, words)``: the filtered model of every sentence.

    N-grams of tags only belong to every sentence; they are returned with a null
    sentence id rather than copied once per sentence.
    """
    text = F.col("words") if text is None else text
    _, parts, free = _word_parts(ngrams, sent_vocab, text)
    pairs = _explode_masks(_common(parts, sent_vocab, ["word"]))
    return pairs.select("sent_id", "words").unionByName(free.select(F.lit(None).cast("bigint").alias("sent_id"), "words"))


def filter_context(ngrams: DataFrame, vocab: DataFrame, mode: str = "single") -> DataFrame:
    """Test all but the last word, return the whole n-gram."""
    text = context_of(F.col("words"))
    return {"single": filter_single, "union": filter_union, "multiple": filter_multiple}[mode](ngrams, vocab, text)


def phrase_relations(phrases: DataFrame, max_len: int) -> DataFrame:
    """``(sent_id, segment, kind)`` for every sub-run of every phrase up to ``max_len`` words.

    kinds: substring; right = ends its phrase; left = starts its phrase; phrase = all of it.
    """
    words = phrases.select("sent_id", F.split("phrase", " ").alias("__w"))
    starts = words.select("sent_id", "__w", F.explode(F.sequence(F.lit(1), F.size("__w"))).alias("__i"))
    room = F.least(F.lit(max_len), F.size("__w") - F.col("__i") + 1)
    runs = starts.select("sent_id", "__w", "__i", F.explode(F.sequence(F.lit(1), room)).alias("__n"))
    at_start = F.col("__i") == 1
    at_end = F.col("__i") + F.col("__n") - 1 == F.size("__w")
    kinds = F.array_compact(
        F.array(
            F.lit("substring"),
            F.when(at_end, "right"),
            F.when(at_start, "left"),
            F.when(at_start & at_end, "phrase"),
        )
    )
    return runs.select(
        "sent_id", F.array_join(F.slice("__w", F.col("__i"), F.col("__n")), " ").alias("segment"), F.explode(kinds).alias("kind")
    ).distinct()


def _body(text: Column) -> Column:
    """The words of an n-gram after a leading tag and before the end mark."""
    split = F.split(text, " ")
    body = F.when(is_tag(F.element_at(split, 1)), F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0)))).otherwise(split)
    stop = F.array_position(body, F.lit(EOS)).cast("int")
    return F.when(stop > 0, F.slice(body, F.lit(1), stop - 1)).otherwise(body)


def _segmentations(ngrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every way to cut an n-gram into consecutive segments, with the kind each must have."""
    cut = ngrams.select("words", _body(F.col("words")).alias("__b")).select("words", "__b", F.size("__b").alias("__n"))
    free = cut.filter("__n = 0").select("words")
    # bit i of the variant set = cut after word i + 1
    variants = cut.filter("__n > 0").select(
        "words", "__b", "__n",
        F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("__n") - 1) - 1)).alias("variant"),
    )
    is_cut = lambda i: F.call_function("shiftright", F.col("variant"), i - 1).bitwiseAND(F.lit(1)) == 1
    begins = F.filter(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: (i == 0) | is_cut(i))
    placed = variants.select("words", "__b", "__n", "variant", begins.alias("__s"))
    each = placed.select("words", "__b", "__n", "variant", F.size("__s").alias("n"), "__s", F.posexplode("__s").alias("__k", "__from"))
    to = F.coalesce(F.get("__s", F.col("__k") + 1), F.col("__n"))
    kind = (
        F.when(F.col("n") == 1, "substring")
        .when(F.col("__k") == 0, "right")
        .when(F.col("__k") == F.col("n") - 1, "left")
        .otherwise("phrase")
    )
    segment = F.array_join(F.slice("__b", F.col("__from") + 1, to - F.col("__from")), " ")
    return each.select("words", "variant", "n", segment.alias("segment"), kind.alias("kind")), free


def _phrase_hits(ngrams: DataFrame, phrases: DataFrame, max_len: int) -> tuple[DataFrame, DataFrame]:
    parts, free = _segmentations(ngrams)
    sets = phrase_relations(phrases, max_len)
    # equal segments inside one variant count once per place, so number the places by grouping them first
    parts = parts.groupBy("words", "variant", "segment", "kind").agg(F.count(F.lit(1)).alias("__r"), F.first("n").alias("n"))
    hits = parts.join(_masks(sets, ["segment", "kind"]), ["segment", "kind"])
    whole = hits.groupBy("words", "variant", "n", "block").agg(F.bit_and("mask").alias("mask"), F.sum("__r").alias("__c"))
    good = whole.filter((F.col("__c") == F.col("n")) & (F.col("mask") != 0))
    return good.groupBy("words", "block").agg(F.bit_or("mask").alias("mask")), free


def filter_phrase(ngrams: DataFrame, phrases: DataFrame, mode: str = "union", max_len: int | None = None) -> DataFrame:
    """Keep n-grams that phrases of one sentence, clipped at both ends, can spell.

    ``phrases(sent_id, phrase)`` with single spaces.  A leading tag is skipped and
    the n-gram stops at the end mark; nothing left means keep.  ``max_len``, the
    words of the longest segment, is by default that of the longest n-gram.
    """
    if max_len is None:
        max_len = ngrams.agg(F.max(F.size(F.split("words", " ")))).first()[0] or 1
    # a word in no phrase at all rules the n-gram out before it is cut
    vocab = phrases.select(F.explode(F.split("phrase", " ")).alias("word"))
    able = materialise(filter_single(ngrams, vocab, F.array_join(_body(F.col("words")), " ")), "able")
    good, free = _phrase_hits(able, phrases, max_len)
    if mode == "union":
        return able.join(good.select("words").distinct().unionByName(free), "words", "left_semi")
    pairs = _explode_masks(good).select("sent_id", "words")
    return pairs.unionByName(free.select(F.lit(None).cast("bigint").alias("sent_id"), "words"))


def phrase_table_vocab(sentences: DataFrame, table: DataFrame, max_len: int = 7) -> DataFrame:
    """``(sent_id, word)``: target words reachable from each sentence plus its own words.

    ``sentences(sent_id, tokens)``, ``table(source, target)``.  Only runs of a
    length that a source of the table has are made, once per sentence row.
    """
    reach = materialise(table.select("source", F.explode(F.filter(F.split("target", " "), lambda t: t != "")).alias("word")).distinct(), "reach")
    sizes = reach.select(F.size(F.split("source", " ")).alias("n")).distinct().filter(F.col("n") <= max_len)
    sizes = sorted(r[0] for r in sizes.collect())  # at most max_len
    own = sentences.select("sent_id", F.explode(F.array_distinct("tokens")).alias("word"))
    if not sizes:
        return own.distinct()

    def runs(n: int) -> Column:
        last = F.size("tokens") - n + 1
        at = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice("tokens", i, F.lit(n)), " "))

    sources = F.array_distinct(F.concat(*[runs(n) for n in sizes]))
    found = sentences.filter(F.size("tokens") > 0).select("sent_id", F.explode(sources).alias("source"))
    return own.unionByName(found.join(reach, "source").select("sent_id", "word")).distinct()
