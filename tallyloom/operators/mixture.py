"""Mixture weights over sources and sampling to a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import rank_by_hash
from ..functions.stable import stable_hash


def source_stats(df: DataFrame, source: str, tokens: str) -> DataFrame:
    """Rows, tokens and median length per source."""
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), F.sum(tokens).cast("bigint").alias("tokens"), F.percentile(F.col(tokens), F.lit(0.5)).alias("p50")
    )


def _shares(stats: DataFrame, weight: Column) -> DataFrame:
    # one row per source is left here, so the global window sees only the source list
    weighed = stats.withColumn("weight", weight)
    return weighed.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy()))


def mix_proportional(stats: DataFrame) -> DataFrame:
    return _shares(stats, F.col("n").cast("double"))


def mix_temperature(stats: DataFrame, tau: float) -> DataFrame:
    return _shares(stats, F.pow(F.col("n").cast("double"), F.lit(tau)))


def mix_lads(stats: DataFrame, tau: float = 0.7, beta: float = 0.5) -> DataFrame:
    """N^tau * ln(L + 1)^beta with the median length as L."""
    return _shares(stats, F.pow(F.col("n").cast("double"), F.lit(tau)) * F.pow(F.log1p("p50"), F.lit(beta)))


def sample_to_token_budget(
    df: DataFrame, shares: DataFrame, source: str, id_col: str, tokens: str, budget: int, seed: int
) -> DataFrame:
    """Rows with the number of ``copies`` to take so each source meets its part of the budget.

    Whole passes over a short source first, then rows in hash order until the
    running token count reaches the rest (the last row may overshoot).
    """
    hashed = df.withColumn("__h", stable_hash(F.col(id_col), seed))
    ran = rank_by_hash(hashed, [source], "__h", [id_col], rank=None, amount=tokens, running="__end")
    want = F.col("share") * budget
    plan = shares.filter("tokens > 0").select(
        source,
        F.floor(want / F.col("tokens")).cast("bigint").alias("__full"),
        (want - F.floor(want / F.col("tokens")) * F.col("tokens")).alias("__rest"),
    )
    joined = ran.join(plan, source)
    extra = ((F.col("__end") - F.col(tokens)) < F.col("__rest")).cast("bigint")
    return joined.withColumn("copies", F.col("__full") + extra).filter("copies > 0").drop("__h", "__end", "__full", "__rest")


def mixture_report(sampled: DataFrame, original: DataFrame, source: str, tokens: str) -> DataFrame:
    """Token and sample shares per source and the compression ratio."""
    taken = sampled.groupBy(source).agg(
        F.sum("copies").cast("bigint").alias("samples"), F.sum(F.col("copies") * F.col(tokens)).cast("bigint").alias("tokens")
    )
    base = original.groupBy(source).agg(F.sum(tokens).cast("bigint").alias("source_tokens"))
    everything = Window.partitionBy()  # one row per source
    return base.join(taken, source, "left").na.fill(0).select(
        source,
        "samples",
        "tokens",
        (F.col("samples") / F.sum("samples").over(everything)).alias("sample_share"),
        (F.col("tokens") / F.sum("tokens").over(everything)).alias("token_share"),
        (F.col("tokens") / F.col("source_tokens")).alias("compression_ratio"),
    )


def token_type_coverage(sampled: DataFrame, original: DataFrame, token_array: str) -> DataFrame:
    """Share of the original's token types that the sample still holds."""
    kept = sampled.select(F.explode(token_array).alias("w")).distinct().withColumn("__in", F.lit(1))
    types = original.select(F.explode(token_array).alias("w")).distinct()
    return types.join(kept, "w", "left").agg(
        F.count(F.lit(1)).alias("types"), F.count("__in").alias("covered"), (F.count("__in") / F.count(F.lit(1))).alias("coverage")
    )


def effective_token_ratio(df: DataFrame, valid: Column, kept: Column, tokens: str) -> DataFrame:
    """Tokens of valid, non-duplicate rows over all tokens."""
    good = F.sum(F.when(valid & kept, F.col(tokens)).otherwise(0)).cast("bigint")
    total = F.sum(tokens).cast("bigint")
    return df.agg(total.alias("tokens"), good.alias("effective"), (good / total).alias("ratio"))
