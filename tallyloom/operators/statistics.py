"""Paired comparisons, bootstrap, PCA, mediation effects and trend tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import rank_by_order
from ..functions.stable import HASH_BITS, stable_hash
from ..session import materialise


def paired_join(a: DataFrame, b: DataFrame, key: str, value: str, weights: Sequence[str], order: str | None = None) -> DataFrame:
    """``(key, a, b, delta, weight)``; in b the last duplicate of a key wins.

    The weight is the first of ``weights`` that is neither null nor empty text,
    else 1; a zero counts.
    """
    if order:
        b = b.groupBy(key).agg(F.max_by(value, order).alias(value))
    w = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")).cast("double") for c in weights], F.lit(1.0))
    left = a.select(key, F.col(value).alias("a"), w.alias("weight"))
    return left.join(b.select(key, F.col(value).alias("b")), key).select(key, "a", "b", (F.col("a") - F.col("b")).alias("delta"), "weight")


def paired_summary(pairs: DataFrame) -> DataFrame:
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    mean = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / n
    wsum = F.greatest(F.sum("weight"), F.lit(1.0))
    weighted = lambda c: F.sum(F.col(c) * F.col("weight")) / wsum
    return pairs.agg(
        F.count(F.lit(1)).alias("paired_count"),
        F.count_if(F.col("delta") > 0).alias("better_count"),
        (F.count_if(F.col("delta") > 0) / n * 100.0).alias("better_pct"),
        mean("a").alias("mean_a"), mean("b").alias("mean_b"), mean("delta").alias("mean_delta"),
        (mean("delta") / F.greatest(mean("a"), F.lit(1e-12)) * 100.0).alias("relative_improvement_pct"),
        weighted("a").alias("weighted_a"), weighted("b").alias("weighted_b"), weighted("delta").alias("weighted_delta"),
    )


def poisson_cuts(limit: int = 12) -> list[int]:
    """Hash values at which a Poisson(1) draw grows by one.

    The chance of a draw above ``limit`` is below the resolution of a 32-bit hash.
    """
    cuts, total, term = [], 0.0, math.exp(-1.0)
    for k in range(limit):
        total += term
        cuts.append(int(total * 2**HASH_BITS))
        term /= k + 1
    return cuts


def _round_hash(key: Column, round_no: Column, seed: int) -> Column:
    digest = F.md5(F.concat_ws(":", key.cast("string"), round_no.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def _interval(means: DataFrame, rounds: int, level: float) -> DataFrame:
    tail = (1.0 - level) / 2
    low, high = int(tail * (rounds - 1)), int((1.0 - tail) * (rounds - 1))
    sorted_means = F.sort_array(F.collect_list("m"))  # one number per round
    return means.agg(sorted_means.alias("s")).select(F.get("s", F.lit(low)).alias("ci_low"), F.get("s", F.lit(high)).alias("ci_high"))


#: The multipliers and the step of the 32-bit mixing function of the draws.
MIX_1, MIX_2, GOLDEN = 2146121005, 2221713035, 2654435769
CHUNK = 1024  # rows that are weighed together
FIXED = 38  # bits of a value over the largest one; weights of at most 12 keep a chunk's sum below 53


def draw_bits(seed: np.ndarray, rounds: int) -> np.ndarray:
    """32 bits per seed and round, by mixing the seed with a counter."""
    x = seed[:, None] + np.arange(rounds, dtype=np.uint32) * np.uint32(GOLDEN)
    x ^= x >> np.uint32(16)
    x *= np.uint32(MIX_1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(MIX_2)
    x ^= x >> np.uint32(16)
    return x


def _whole(rows: DataFrame, value: str) -> tuple[DataFrame, float, int]:
    """``__v`` as whole numbers of FIXED bits below the largest size, that size, and the number of rows with a value."""
    valued = rows.filter(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double"))
    top, count = valued.agg(F.max(F.abs("__v")), F.count(F.lit(1))).first()
    scale = math.ldexp(1.0, FIXED - math.frexp(top)[1]) if top else 1.0
    return valued.withColumn("__v", F.round(F.col("__v") * scale).cast("bigint")), scale, count


def _merged_means(parts: DataFrame, scale: float) -> DataFrame:
    """``(r, m)`` from one row of round sums per task; sums of whole numbers do not depend on their order."""
    each = parts.select(F.posexplode(F.arrays_zip("total", "weight")).alias("r", "x"))
    sums = each.groupBy("r").agg(F.sum(F.col("x.total").cast("decimal(38,0)")).alias("t"), F.sum("x.weight").alias("w"))
    return sums.select("r", (F.col("t").cast("double") / F.greatest("w", F.lit(1)) / scale).alias("m"))


def _part(totals: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([totals], pa.list_(pa.int64())), pa.array([weights], pa.list_(pa.int64()))], names=["total", "weight"])


def bootstrap_ci(rows: DataFrame, id_col: str, value: str, rounds: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Interval of the mean by a Poisson bootstrap: one scan, no resampled table.

    Every row takes part in each round with a Poisson(1) weight, drawn by mixing
    its hash with the round's number.  A task adds its rows up to one vector of
    round sums; only these vectors are shuffled, rounds x tasks numbers.  Values
    are whole numbers there, so the interval is the same for any partitioning.
    Rows without a value take no part.
    """
    valued, scale, _ = _whole(rows.select(F.col(id_col).alias("__id"), value), value)
    cuts = np.array(poisson_cuts(), np.uint64)
    cuts = cuts[cuts < 1 << 32].astype(np.uint32)

    def add(batches):
        totals, weights, held = np.zeros(rounds, np.int64), np.zeros(rounds, np.int64), 0
        for batch in batches:
            seeds, values = batch.column(0).to_numpy().astype(np.uint32), batch.column(1).to_numpy().astype(float)
            for i in range(0, len(seeds), CHUNK):
                bits = draw_bits(seeds[i : i + CHUNK], rounds)
                weight = sum((bits >= c).astype(np.float64) for c in cuts)
                totals += (values[i : i + CHUNK] @ weight).astype(np.int64)  # exact in doubles, see FIXED
                weights += weight.sum(axis=0).astype(np.int64)
                held += len(weight)
                if held >= 1 << 20:  # no sum of so many leaves 64 bits
                    yield _part(totals, weights)
                    totals, weights, held = np.zeros(rounds, np.int64), np.zeros(rounds, np.int64), 0
        if held:
            yield _part(totals, weights)

    parts = valued.select(stable_hash(F.col("__id"), seed).alias("s"), "__v").mapInArrow(add, "total array<bigint>, weight array<bigint>")
    return _interval(_merged_means(parts, scale), rounds, level)


DRAWS = 1 << 21  # draws of one task


def bootstrap_ci_exact(rows: DataFrame, order: str, value: str, rounds: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Resampling with replacement: draw i of round r is row hash(r, i) mod n.

    A draw needs its number alone, so draws are made from a range that is cut by
    their number and not by the size of the ranked table; each goes once to the
    row it names, whose table is the hashed side of the join.
    """
    spark = rows.sparkSession
    ranked = rank_by_order(rows.select(order, F.col(value).cast("double").alias("__v")), [], [order], rank="__r")
    ranked = materialise(ranked.select("__r", "__v"), "ranked")
    n = ranked.count()
    numbers = spark.range(1, n + 1, 1, max(1, math.ceil(n * rounds / DRAWS)))
    draws = numbers.select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
    picked = draws.select("r", (F.pmod(_round_hash(F.col("id"), F.col("r"), seed), F.lit(n)) + 1).alias("__r"))
    means = picked.join(ranked.hint("shuffle_hash"), "__r").groupBy("r").agg(F.avg("__v").alias("m"))
    return _interval(means, rounds, level)


LEAF = 1024  # ranks of a leaf of the tree of draws


def leaf_draws(leaf: int, n: int, rounds: int, seed: int, width: int = LEAF) -> np.ndarray:
    """How many of n draws fall on a leaf's ranks in each round.

    A tree halves the leaves; at every node a binomial number of its draws goes
    to the left.  A node's numbers come from a generator of its own, so every
    leaf finds the same ones on its way down.
    """
    counts, low, high = np.full(rounds, n, np.int64), 0, -(-n // width)
    while high - low > 1:
        mid = (low + high) // 2
        size, left = min(high * width, n) - low * width, (mid - low) * width
        generator = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), (low << 32) | high]))
        to_left = generator.binomial(counts, left / size)
        counts, low, high = (to_left, low, mid) if leaf < mid else (counts - to_left, mid, high)
    return counts


def bootstrap_ci_multinomial(rows: DataFrame, order: str, value: str, rounds: int = 2000, seed: int = 0, level: float = 0.95, width: int = LEAF) -> DataFrame:
    """Resampling with replacement, n of n rows in every round, for tables of any size.

    Rows are ranked by ``order`` and cut into leaves of ``width`` ranks.  The number of
    draws on each leaf splits down a tree, then a leaf draws its rows by itself,
    so no draw is shuffled: a task gives one vector of round sums.  The leaves hang
    on ranks alone, so the interval is the same for any partitioning.
    """
    valued, scale, n = _whole(rows.select(order, value), value)
    ranked = rank_by_order(valued.select(order, "__v"), [], [order, "__v"], rank="__r")
    placed = ranked.select(((F.col("__r") - 1) / width).cast("bigint").alias("leaf"), (F.col("__r") - 1).alias("at"), "__v")
    placed = placed.repartition("leaf").sortWithinPartitions("leaf", "at")

    def sums(leaf: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = leaf_draws(leaf, n, rounds, seed, width)
        generator = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), (1 << 63) | leaf]))
        picked = generator.integers(0, len(values), int(counts.sum()))
        ends = np.cumsum(counts)
        running = np.concatenate([[0], np.cumsum(values[picked])])
        return running[ends] - running[ends - counts], counts

    def draw(batches):
        leaf, held, out = None, [], []
        totals, weights = np.zeros(rounds, np.int64), np.zeros(rounds, np.int64)
        done = 0

        def close():
            nonlocal totals, weights, done
            t, w = sums(leaf, np.concatenate(held))
            totals, weights, done = totals + t, weights + w, done + 1
            if done % 128 == 0:
                out.append(_part(totals, weights))
                totals, weights = np.zeros(rounds, np.int64), np.zeros(rounds, np.int64)

        for batch in batches:
            leaf_of, values = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(leaf_of[1:] != leaf_of[:-1]) + 1).tolist(), len(leaf_of)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if held and leaf_of[a] != leaf:
                        close()
                        held = []
                    leaf = int(leaf_of[a])
                    held.append(values[a:b])
            yield from out
            out.clear()
        if held:
            close()
        yield from out
        if done % 128:
            yield _part(totals, weights)

    parts = placed.mapInArrow(draw, "total array<bigint>, weight array<bigint>")
    return _interval(_merged_means(parts, scale), rounds, level)


def pca(rows: DataFrame, features: str, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Projections on the top k components of the centred data, components and variances (1/N).

    The sign makes the largest absolute loading positive.  The driver holds one
    d x d matrix; d is the vector length, not the number of rows.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    n, *means = rows.select(F.size(features).alias("__d"), features).agg(
        F.count(F.lit(1)), F.max("__d")
    ).first()
    d = means[0]
    mean_row = rows.select(F.posexplode(features).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = [r["m"] for r in sorted(mean_row.collect(), key=lambda r: r["dim"])]  # one number per dimension
    centred = F.zip_with(F.col(features), F.array(*[F.lit(c) for c in centre]), lambda x, m: x.cast("double") - m)
    prepared = rows.withColumn("__c", centred)
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(prepared.select(array_to_vector("__c").alias("__v")))
    loads = model.pc.toArray()
    loads = loads * np.sign(loads[np.abs(loads).argmax(axis=0), np.arange(k)])
    dot = lambda j: F.aggregate(
        F.zip_with("__c", F.array(*[F.lit(float(v)) for v in loads[:, j]]), lambda x, v: x * v), F.lit(0.0), lambda a, x: a + x
    )
    projected = prepared.select(*rows.columns, F.array(*[dot(j) for j in range(k)]).alias("projection"))
    squares = projected.agg(*[F.avg(F.pow(F.col("projection")[j], 2)).alias(f"v{j}") for j in range(k)]).first()
    assert d == len(centre) and n
    return projected, loads, np.array([squares[f"v{j}"] for j in range(k)])


def least_squares(rows: DataFrame, y: str | Column, xs: Sequence[str | Column]) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients (intercept first), their standard errors and n, from one aggregation of p x p sums."""
    cols = [F.lit(1.0), *[F.col(x) if isinstance(x, str) else x for x in xs]]
    target = F.col(y) if isinstance(y, str) else y
    p = len(cols)
    sums = [F.sum((cols[i] * cols[j]).cast("double")).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [F.sum((cols[i] * target).cast("double")).alias(f"y{i}") for i in range(p)]
    r = rows.agg(*sums, F.sum((target * target).cast("double")).alias("yy"), F.count(F.lit(1)).alias("n")).first()
    xx = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    xy = np.array([r[f"y{i}"] for i in range(p)])
    beta = np.linalg.solve(xx, xy)
    residual = max(r["yy"] - float(beta @ xy), 0.0)
    return beta, np.sqrt(np.diag(np.linalg.inv(xx)) * residual / max(r["n"] - p, 1)), r["n"]


def natural_effects(rows: DataFrame, y: str, a: str, m: str, covariates: Sequence[str]) -> dict[str, float]:
    """Natural direct and indirect effect, total effect and proportion mediated.

    Outcome model with an exposure-mediator interaction, linear mediator model;
    both fits and the averaging are single aggregations.
    """
    beta, _, _ = least_squares(rows, y, [a, m, F.col(a) * F.col(m), *covariates])
    theta, _, _ = least_squares(rows, m, [a, *covariates])
    base = F.lit(float(theta[0]))
    for c, t in zip(covariates, theta[2:]):
        base = base + F.col(c) * float(t)
    m0, m1 = base, base + float(theta[1])
    b_a, b_m, b_am = float(beta[1]), float(beta[2]), float(beta[3])
    effects = rows.agg(
        F.avg(F.lit(b_a) + m0 * b_am).alias("nde"), F.avg((m1 - m0) * (b_m + b_am)).alias("nie")
    ).first()
    total = effects["nde"] + effects["nie"]
    return {"nde": effects["nde"], "nie": effects["nie"], "total": total, "proportion_mediated": effects["nie"] / total if total else math.nan}


def trend_test(rows: DataFrame, level: str, case: Column) -> DataFrame:
    """Cochran-Armitage z for a linear trend of a binary outcome over ordered levels."""
    per = rows.groupBy(F.col(level).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.sum(case.cast("bigint")).alias("r"))
    sums = per.agg(
        F.sum("n").alias("N"), F.sum("r").alias("R"), F.sum(F.col("x") * F.col("r")).alias("xr"),
        F.sum(F.col("x") * F.col("n")).alias("xn"), F.sum(F.col("x") * F.col("x") * F.col("n")).alias("xxn"),
    )
    p = F.col("R") / F.col("N")
    score = F.col("xr") - p * F.col("xn")
    variance = p * (1 - p) * (F.col("xxn") - F.col("xn") * F.col("xn") / F.col("N"))
    return sums.select(F.col("N").alias("n"), F.col("R").alias("cases"), (score / F.sqrt(variance)).alias("z"))


def p_value(z: float) -> float:
    """Two-sided normal tail."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def wald_test(rows: DataFrame, y: str, xs: Sequence[str], family: str = "gaussian") -> list[dict]:
    """Coefficient, standard error, z and p per term of a linear or logistic model."""
    names = ["intercept", *xs]
    if family == "gaussian":
        beta, se, _ = least_squares(rows, y, list(xs))
    else:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GeneralizedLinearRegression

        ready = VectorAssembler(inputCols=list(xs), outputCol="__x").transform(rows.select(y, *xs))
        fit = GeneralizedLinearRegression(family=family, featuresCol="__x", labelCol=y).fit(ready)
        errors = fit.summary.coefficientStandardErrors  # the intercept comes last
        beta, se = [fit.intercept, *fit.coefficients], [errors[-1], *errors[:-1]]
    return [
        {"term": t, "coefficient": float(b), "se": float(s), "z": float(b / s), "p": p_value(float(b / s))} for t, b, s in zip(names, beta, se)
    ]
