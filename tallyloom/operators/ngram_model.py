"""N-gram language models with modified Kneser-Ney smoothing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import BOS, EOS, SLICES, SPECIALS, UNK, context_of, context_slice, last_word, ngram_rows, slice_of, suffix_of
from ..session import Growing, materialise, scratch

FALLBACK_DISCOUNTS = (0.5, 1.0, 1.5)
#: N-grams that a step on large tables joins at a time, as far as slices allow.
PART_ROWS = 4_000_000


def sliced(rows: DataFrame) -> DataFrame:
    """Rows of ``words`` with their ``slice``; tables written with it are read slice by slice."""
    return rows if "slice" in rows.columns else rows.withColumn("slice", slice_of(F.col("words")))


def parts(sizes: Mapping[int, int]) -> list[Column]:
    """Conditions on ``slice``, from the rows of each slice; every slice, also one without rows, is in one part."""
    n = min(SLICES, max(1, -(-sum(sizes.values()) // PART_ROWS)))
    if n == 1:
        return [F.lit(True)]
    found: list[list[int]] = [[] for _ in range(n)]
    weight = [0] * n
    for s in sorted(range(SLICES), key=lambda s: -sizes.get(s, 0)):
        least = weight.index(min(weight))
        found[least].append(s)
        weight[least] += max(1, sizes.get(s, 0))
    return [F.col("slice").isin(f) for f in found if f]


def sizes_of(rows: DataFrame, amount: Column | None = None) -> dict[int, dict[int, int]]:
    """Rows by order and slice: at most ``SLICES`` numbers an order."""
    n = F.count(F.lit(1)) if amount is None else F.sum(amount)
    out: dict[int, dict[int, int]] = {}
    for r in rows.groupBy("order", "slice").agg(n.alias("n")).collect():
        out.setdefault(r["order"], {})[r["slice"]] = int(r["n"] or 0)
    return out


def below(rows: DataFrame, part: Column, order: int) -> DataFrame:
    """Of the rows of the order below, those that can be suffixes of a part's n-grams."""
    return (rows.filter(part) if order > 2 else rows).drop("slice")


def as_contexts(rows: DataFrame, part: Column) -> DataFrame:
    """Of the rows of the order below, those that can be contexts of a part's n-grams."""
    return rows.withColumn("slice", context_slice(F.col("words"))).filter(part).drop("slice")


def ngram_counts(sentences: DataFrame, order: int) -> DataFrame:
    """Full-length n-grams with start padding and their counts: ``(words, raw)``."""
    rows = ngram_rows(sentences, "tokens", order, [], pad=order - 1)
    return rows.groupBy("words").agg(F.count(F.lit(1)).alias("raw"))


def corpus_totals(sentences: DataFrame) -> DataFrame:
    """Token count (end marks not counted) and number of word types, specials included."""
    words = sentences.select(F.explode("tokens").alias("word"))
    seen = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return seen.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("tokens"),
        (F.count(F.lit(1)) + len(SPECIALS)).cast("bigint").alias("types"),
    )


def map_to_vocabulary(sentences: DataFrame, vocab: DataFrame, keys: list[str]) -> DataFrame:
    """Replace words outside ``vocab(word)`` by the unknown word.

    The unknown *types* are found once; each sentence then only looks up its own
    distinct words, so a frequent word is not joined once per occurrence.
    """
    types = sentences.select(F.explode("tokens").alias("word")).distinct()
    unknown = types.join(vocab.select("word"), "word", "left_anti")
    holders = (
        sentences.select(*keys, F.explode(F.array_distinct("tokens")).alias("word"))
        .join(unknown, "word", "left_semi")
        .groupBy(*keys)
        .agg(F.collect_set("word").alias("__unknown"))
    )
    joined = sentences.join(holders, keys, "left")
    swapped = F.transform(
        "tokens", lambda t: F.when(F.array_contains(F.col("__unknown"), t), F.lit(UNK)).otherwise(t)
    )
    return joined.select(*keys, F.when(F.col("__unknown").isNull(), F.col("tokens")).otherwise(swapped).alias("tokens"))


def count_ngrams(sentences: DataFrame, order: int, vocab: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Counts only, with a growing vocabulary or a given one."""
    if vocab is not None:
        sentences = map_to_vocabulary(sentences, vocab, list(keys))
    return ngram_counts(sentences, order)


def adjusted_counts(top: DataFrame, order: int) -> DataFrame:
    """Adjusted counts of every order: ``(order, words, raw, adj, pruned, slice)``.

    The rows of order k+1 are distinct, so the number of distinct left words of
    a suffix is a plain row count: each lower order costs one partially combined
    aggregation over the (smaller) order above.  Each order is written once: left
    lazy, the filters of the branches below would be pushed into the counting and
    the corpus would be read once per order.
    """
    spark = top.sparkSession
    raw = F.col("raw").cast("bigint")
    write = lambda k, rows: materialise(sliced(rows), f"counts{k}", by=["slice"], sort=["words"])
    levels = {order: write(order, top.select("words", raw.alias("raw"), raw.alias("adj")))}
    for k in range(order - 1, 0, -1):
        above = levels[k + 1]
        grouped = above.groupBy(suffix_of(F.col("words")).alias("words")).agg(
            F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("lefts")
        )
        from_start = F.col("words").startswith(BOS + " ") | (F.col("words") == BOS)
        adjusted = F.when(from_start, F.col("raw")).otherwise(F.col("lefts")).alias("adj")
        levels[k] = write(k, grouped.select("words", "raw", adjusted))
    out = None
    for k, level in levels.items():
        rows = level.filter(~F.col("words").startswith(f"{BOS} {BOS}")) if k > 1 else level.filter(~F.col("words").isin(BOS, UNK))
        rows = rows.select(F.lit(k).alias("order"), "words", "raw", "adj", "slice")
        out = rows if out is None else out.unionByName(rows)
    marks = spark.createDataFrame([(1, UNK, 0, 0, 0), (1, BOS, 0, 0, 0)], "order int, words string, raw bigint, adj bigint, slice int")
    return out.unionByName(marks).select("order", "words", "raw", "adj", F.lit(False).alias("pruned"), "slice")


def prune(counts: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Mark n-grams whose raw count is at most the threshold of their order."""
    if list(thresholds) != sorted(thresholds):
        raise ValueError("pruning thresholds must not decrease")
    limits = F.array(*[F.lit(int(t)) for t in thresholds])
    limit = F.element_at(limits, F.least(F.col("order"), F.lit(len(thresholds))))
    special = (F.col("order") == 1) & F.col("words").isin(*SPECIALS)
    return counts.withColumn("pruned", F.col("pruned") | ((F.col("raw") <= limit) & ~special))


def limit_vocabulary(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Mark n-grams that hold a word outside ``vocab(word)``; special words always pass."""
    words = counts.select("order", "words", F.explode(F.array_distinct(F.split("words", " "))).alias("word"))
    outside = (
        words.filter(~F.col("word").isin(*SPECIALS))
        .join(vocab.select("word"), "word", "left_anti")
        .select("order", "words")
        .distinct()
        .withColumn("__out", F.lit(True))
    )
    joined = counts.join(outside, ["order", "words"], "left")
    return joined.select(
        "order", "words", "raw", "adj", (F.col("pruned") | F.col("__out").isNotNull()).alias("pruned"), *[c for c in counts.columns if c == "slice"]
    )


def count_of_counts(counts: DataFrame) -> DataFrame:
    """Per order n1..n4, all rows and kept rows: at most one row per order."""
    numbers = [F.count_if(F.col("adj") == i).alias(f"n{i}") for i in range(1, 5)]
    return counts.groupBy("order").agg(
        *numbers, F.count(F.lit(1)).alias("total"), F.count_if(~F.col("pruned")).alias("kept")
    )


def kn_discounts(stats: DataFrame, fallback: Sequence[float] | None = None) -> DataFrame:
    """Closed-form discounts D1, D2, D3+ per order; bad ones raise or take the fallback."""
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    raw = {j: F.lit(j) - (j + 1) * y * F.col(f"n{j + 1}") / F.col(f"n{j}") for j in (1, 2, 3)}
    ok = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    stats = stats.withColumn("__ok", ok).withColumns(
        {f"__d{j}": F.when(F.col("__ok"), raw[j]) for j in (1, 2, 3)}
    )
    good = F.coalesce(
        F.col("__ok") & F.forall(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"__d{j}").alias("d")) for j in (1, 2, 3)]),
                                 lambda s: (s["d"] >= 0) & (s["d"] <= s["j"])),
        F.lit(False),
    )
    def pick(j: int) -> Column:
        if fallback is None:
            other = F.raise_error(F.concat(F.lit("bad discount at order "), F.col("order"))).cast("double")
        else:
            other = F.lit(float(fallback[j - 1]))
        return F.when(good, F.col(f"__d{j}")).otherwise(other).alias(f"d{j}")
    return stats.select("order", *[pick(j) for j in (1, 2, 3)])


def _with_discount(counts: DataFrame, discounts: DataFrame) -> DataFrame:
    # one row per order by construction, so the broadcast cannot grow with the data
    joined = counts.join(F.broadcast(discounts), "order")
    adj = F.col("adj")
    d = F.when(adj == 0, 0.0).when(adj == 1, F.col("d1")).when(adj == 2, F.col("d2")).otherwise(F.col("d3"))
    return joined.select(*counts.columns, d.alias("discount"))


def context_stats(counts: DataFrame, discounts: DataFrame) -> DataFrame:
    """Per context of an order: denominator and the mass left for the lower order."""
    rows = _with_discount(counts.select("order", context_of(F.col("words")).alias("context"), "adj", "pruned"), discounts)
    lost = F.when(F.col("pruned"), F.col("adj").cast("double")).otherwise(F.col("discount"))
    return rows.groupBy("order", "context").agg(
        F.sum("adj").alias("denominator"), F.sum(lost).alias("__lost")
    ).select("order", "context", "denominator", (F.col("__lost") / F.col("denominator")).alias("gamma"), context_slice(F.col("context")).alias("slice"))


def write_contexts(counts: DataFrame, discounts: DataFrame) -> DataFrame:
    """``context_stats``, written part by part: a context's n-grams share a slice."""
    counts = sliced(counts)
    out = Growing(counts.sparkSession, "contexts")
    for k, sizes in sizes_of(counts).items():
        for part in parts(sizes):
            out.add(k, context_stats(counts.filter((F.col("order") == k) & part), discounts), "context")
    return out.read()


def uninterpolated(counts: DataFrame, discounts: DataFrame, contexts: DataFrame, interpolate_unigrams: bool = True) -> DataFrame:
    """Discounted relative frequencies of kept rows with their context's gamma.

    An n-gram goes to its context as that context and its last word, once each;
    the context comes first among the keys, so that the sort tells rows apart early.
    """
    rows = sliced(counts).filter(~F.col("pruned")).select("order", "words", "adj", "slice")
    first = contexts.filter("order = 1")  # the empty context: one row
    one = rows.filter("order = 1").join(F.broadcast(first.select("order", "context", "denominator", "gamma")), "order")
    apart = rows.filter("order > 1").select(context_of(F.col("words")).alias("context"), "order", "slice", last_word(F.col("words")).alias("__last"), "adj")
    more = apart.join(contexts.filter("order > 1").drop("slice"), ["context", "order"]).withColumn("words", F.concat_ws(" ", "context", "__last"))
    cols = ["order", "words", "context", "adj", "denominator", "gamma", "slice"]
    both = _with_discount(one.select(cols).unionByName(more.select(cols)), discounts)
    share = (F.col("adj") - F.col("discount")) / F.col("denominator")
    unigram = F.col("order") == 1
    is_unk, is_bos = unigram & (F.col("words") == UNK), unigram & (F.col("words") == BOS)
    if interpolate_unigrams:
        u = F.when(is_bos, 1.0).when(is_unk, 0.0).otherwise(share)
        g = F.when(is_bos, 0.0).otherwise(F.col("gamma"))
    else:
        u = F.when(is_bos, 1.0).when(is_unk, F.col("gamma")).otherwise(share)
        g = F.when(unigram, 0.0).otherwise(F.col("gamma"))
    return both.select("order", "words", "context", u.alias("u"), g.alias("gamma"), "slice")


def uninterpolated_part(
    counts: DataFrame, discounts: DataFrame, contexts: DataFrame, interpolate_unigrams: bool = True
) -> Callable[[int, Column], DataFrame]:
    """``uninterpolated`` of one order's part, from that part of both tables."""
    counts = sliced(counts)

    def rows(order: int, part: Column) -> DataFrame:
        own = (F.col("order") == order) & part
        return uninterpolated(counts.filter(own), discounts, contexts.filter(own), interpolate_unigrams)

    return rows


def write_uninterpolated(counts: DataFrame, discounts: DataFrame, contexts: DataFrame, interpolate_unigrams: bool = True) -> DataFrame:
    """``uninterpolated``, without the column ``context``, written part by part."""
    rows = uninterpolated_part(counts, discounts, contexts, interpolate_unigrams)
    out = Growing(counts.sparkSession, "uninterpolated")
    for k, sizes in sizes_of(sliced(counts)).items():
        for part in parts(sizes):
            out.add(k, rows(k, part).select("words", "u", "gamma", "slice"))
    return out.read()


def _log10(c: str) -> Column:
    """The logarithm of 0 is minus infinity: without interpolation a discount may take all of a word's count."""
    return F.when(F.col(c) > 0, F.log10(c)).otherwise(F.lit(float("-inf")))


def interpolate_orders(
    u: Callable[[int, Column], DataFrame], contexts: DataFrame, order: int, vocab_pad: int = 0, into: Growing | None = None
) -> DataFrame:
    """Interpolated log10 model ``(order, words, prob, backoff, slice)`` from ``uninterpolated_part``.

    One equi-join with the order below per step.  The model is one table, written
    order by order and part by part, so that neither ``u`` nor the shuffle of a
    whole order is on disk; the next order reads it as the one below.
    """
    kept = u(1, F.lit(True)).count()
    uniform = 1.0 / max(vocab_pad, kept - 1, 1)
    model = into or Growing(contexts.sparkSession, "lm")
    sizes = sizes_of(contexts, F.col("denominator"))  # of an order's rows the sum is the number or more
    for k in range(1, order + 1):
        after = contexts.filter(F.col("order") == k + 1).select(F.col("context").alias("words"), F.col("gamma").alias("bow"))
        for part in parts(sizes.get(k, {})):
            rows = u(k, part)
            if k == 1:
                level = rows.select("words", (F.col("u") + F.col("gamma") * uniform).alias("p"), "slice")
            else:
                lower = below(model.read(k - 1), part, k).select(F.col("words").alias("__s"), F.col("p").alias("__p"))
                apart = rows.select(F.substring_index("words", " ", 1).alias("__first"), suffix_of(F.col("words")).alias("__s"), "u", "gamma", "slice")
                level = apart.join(lower, "__s").select(
                    F.concat_ws(" ", "__first", "__s").alias("words"), (F.col("u") + F.col("gamma") * F.col("__p")).alias("p"), "slice"
                )
            if k < order:
                level = level.join(sliced(after).filter(part).drop("slice"), "words", "left")
                open_end = ~F.substring_index("words", " ", -1).isin(UNK, EOS)
                level = level.select("words", "p", F.when(open_end, F.coalesce("bow", F.lit(1.0))).otherwise(1.0).alias("bow"), "slice")
            else:
                level = level.withColumn("bow", F.lit(1.0))
            model.add(k, level)
    return model.read().select("order", "words", F.least(_log10("p"), F.lit(0.0)).alias("prob"), _log10("bow").alias("backoff"), "slice")


def collapse_q(lm: DataFrame, order: int) -> DataFrame:
    """Fold prob and backoff into one value ``q`` with the same sentence scores: ``(order, words, q)``.

    log q(w) = log p(w) + s(w), where s collects the backoffs of all suffixes of
    w minus those of all suffixes of its context:
    s(w) = s(suffix of w) - backoff(context of w) + backoff(w).
    """
    lm = sliced(lm)
    out = Growing(lm.sparkSession, "q")
    out.add(1, lm.filter("order = 1").select("words", (F.col("prob") + F.col("backoff")).alias("q"), F.col("backoff").alias("s"), "slice"))
    sizes = sizes_of(lm)
    for k in range(2, order + 1):
        own = F.col("backoff") if k < order else F.lit(0.0)
        for part in parts(sizes.get(k, {})):
            rows = lm.filter((F.col("order") == k) & part)
            contexts = as_contexts(lm.filter(F.col("order") == k - 1), part).select(F.col("words").alias("__c"), F.col("backoff").alias("__b"))
            lower = below(out.read(k - 1), part, k).select(F.col("words").alias("__s"), F.col("s").alias("__below"))
            shift = F.coalesce("__below", F.lit(0.0)) - F.coalesce("__b", F.lit(0.0)) + own
            level = rows.join(contexts, context_of(F.col("words")) == F.col("__c"), "left").join(lower, suffix_of(F.col("words")) == F.col("__s"), "left")
            # nothing reads the shifts of the last order
            kept = F.col("s") if k < order else F.lit(None).cast("double")
            out.add(k, level.withColumn("s", shift).select("words", (F.col("prob") + F.col("s")).alias("q"), kept.alias("s"), "slice"))
    return out.read().select("order", "words", "q")


def train(
    sentences: DataFrame,
    order: int,
    fallback: Sequence[float] | None = None,
    thresholds: Sequence[int] | None = None,
    vocab: DataFrame | None = None,
    vocab_pad: int = 0,
    interpolate_unigrams: bool = True,
) -> DataFrame:
    """Corpus to model in one call; of its tables only the model's stays."""
    spark = sentences.sparkSession
    model = Growing(spark, "lm")
    with scratch(spark):
        counts = adjusted_counts(ngram_counts(sentences, order), order)
        if thresholds:
            counts = prune(counts, thresholds)
        if vocab is not None:
            counts = materialise(limit_vocabulary(counts, vocab), "limited", by=["slice"], sort=["order", "words"])
        return smooth(counts, order, fallback, vocab_pad, interpolate_unigrams, model)


def smooth(
    counts: DataFrame,
    order: int,
    fallback: Sequence[float] | None = None,
    vocab_pad: int = 0,
    interpolate_unigrams: bool = True,
    into: Growing | None = None,
) -> DataFrame:
    """Adjusted counts to model."""
    discounts = materialise(kn_discounts(count_of_counts(counts), fallback), "discounts")  # one row per order
    contexts = write_contexts(counts, discounts)
    u = uninterpolated_part(counts, discounts, contexts, interpolate_unigrams)
    return interpolate_orders(u, contexts, order, vocab_pad, into)
