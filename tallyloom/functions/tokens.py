"""Token columns and n-gram string columns.

An n-gram is kept as its words joined by one space.  Tokens never hold a space,
so nothing is lost, and grouping and joining stay on plain UTF-8 strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOS, EOS, UNK = "<s>", "</s>", "<unk>"
SPECIALS = (BOS, EOS, UNK)
DELIMITERS = r"[\x00\t\n\r ]+"
#: Slices that tables of n-grams are cut into.
SLICES = 16


def tokens_of(text: Column, drop: tuple[str, ...] = ()) -> Column:
    """White-space tokens of one line, without empty ones and without ``drop``."""
    parts = F.split(text, DELIMITERS)
    if drop:
        return F.filter(parts, lambda t: (t != "") & ~t.isin(*drop))
    return F.filter(parts, lambda t: t != "")


def last_word(ngram: Column) -> Column:
    return F.substring_index(ngram, " ", -1)


def context_of(ngram: Column) -> Column:
    """All but the last word ('' for a unigram)."""
    return F.rtrim(F.substr(ngram, F.lit(1), F.length(ngram) - F.length(last_word(ngram))))


def suffix_of(ngram: Column) -> Column:
    """All but the first word; only for two words or more."""
    return F.substr(ngram, F.instr(ngram, " ") + 1)


def word_slice(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLICES)).cast("int")


def slice_of(ngram: Column) -> Column:
    """The slice of an n-gram is that of its last but one word, the end of its context; a unigram's is 0.

    So the n-grams of a context share a slice, and one of three words or more shares it with its suffix.
    """
    return F.when(F.instr(ngram, " ") > 0, word_slice(F.substring_index(F.substring_index(ngram, " ", -2), " ", 1))).otherwise(F.lit(0))


def context_slice(context: Column) -> Column:
    """The slice of the n-grams that have this context; '' is that of unigrams."""
    return F.when(context == "", F.lit(0)).otherwise(word_slice(last_word(context)))


def ngram_rows(df: DataFrame, tokens: str, order: int, keep: list[str], pad: int, eos: bool = True) -> DataFrame:
    """One row per position with the window of at most ``order`` words ending there.

    ``pad`` start marks precede the tokens; with ``pad = order - 1`` every window
    is full.  The padded array is computed below the generator, so the row
    expansion and the slicing stay inside generated code.
    """
    end = F.array(F.lit(EOS)) if eos else F.array().cast("array<string>")
    padded = F.concat(F.array_repeat(F.lit(BOS), pad), F.col(tokens), end)
    first = pad + 1
    base = df.select(*keep, padded.alias("__p")).filter(F.size("__p") >= first)
    at = base.select(*keep, "__p", F.explode(F.sequence(F.lit(first), F.size("__p"))).alias("__i"))
    start = F.greatest(F.lit(1), F.col("__i") - (order - 1))
    return at.select(
        *keep,
        (F.col("__i") - first).cast("int").alias("pos"),
        F.array_join(F.slice("__p", start, F.least(F.col("__i"), F.lit(order))), " ").alias("words"),
    )
