"""Ranks and running sums that never put one whole group into one task.

A plain ``row_number() over (partition by g order by o)`` sends every row of a
group to one task.  Here each group is cut into ordered slices; slices are
ranked in parallel and a small per-slice table of totals supplies the offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .stable import HASH_BITS

SLICE = "__slice"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Repartition by ``key`` only if the scan has fewer splits than the cluster has cores.

    A small or single-row-group file would otherwise run its CPU-heavy text work
    in one task; a large input already has more splits and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _finish(
    sliced: DataFrame,
    group: list[str],
    order: list[Column],
    rank: str | None,
    amount: str | None,
    running: str | None,
    total: str | None,
) -> DataFrame:
    keys = [*group, SLICE]
    within = Window.partitionBy(*keys).orderBy(*order)
    measures = [F.count(F.lit(1)).alias("__n")]
    if amount:
        measures.append(F.sum(amount).alias("__a"))
    slices = sliced.groupBy(*keys).agg(*measures)
    earlier = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = slices.select(
        *keys,
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n0"),
        F.sum("__n").over(whole).alias("__total"),
        *([F.coalesce(F.sum("__a").over(earlier), F.lit(0)).alias("__a0")] if amount else []),
    )
    local = sliced.withColumn("__rn", F.row_number().over(within))
    if amount:
        local = local.withColumn("__ra", F.sum(amount).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    left, right = local.alias("l"), offsets.alias("r")
    matched = left.join(
        right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "inner"
    )
    kept = [F.col(f"l.{c}").alias(c) for c in sliced.columns if c != SLICE]
    if rank:
        kept.append((F.col("__n0") + F.col("__rn")).cast("bigint").alias(rank))
    if running:
        kept.append((F.col("__a0") + F.col("__ra")).alias(running))
    if total:
        kept.append(F.col("__total").cast("bigint").alias(total))
    return matched.select(*kept)


def rank_by_hash(
    df: DataFrame,
    group: Sequence[str],
    hash_col: str,
    ties: Sequence[str],
    rank: str | None = "rank",
    amount: str | None = None,
    running: str | None = None,
    total: str | None = None,
    slice_bits: int = 10,
) -> DataFrame:
    """Order by an evenly spread 32-bit hash: the slice is its top bits."""
    sliced = df.withColumn(SLICE, F.shiftright(F.col(hash_col), HASH_BITS - slice_bits))
    order = [F.col(hash_col), *[F.col(c) for c in ties]]
    return _finish(sliced, list(group), order, rank, amount, running, total)


def rank_by_order(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column | str],
    rank: str | None = "rank",
    amount: str | None = None,
    running: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Order by any sortable columns: the slice is a range partition.

    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    return _finish(_ranged(df, group, order), list(group), order, rank, amount, running, total)


def _ranged(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with the range partition that they fall in.

    Range bounds are sampled anew on every run, so the partition number is
    written out with the rows before it is read twice.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order)
    return materialise(ranged.withColumn(SLICE, F.spark_partition_id().cast("bigint")), "ranged")


def _with_previous(sliced: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """``__before``, a struct of the value ``v`` of the row before in its group, null for the first.

    Each slice hands its last value on to the next one.
    """
    keys = [*group, SLICE]
    held = F.struct(F.col(value).alias("v"))
    ends = sliced.groupBy(*keys).agg(F.max_by(held, F.struct(*order)).alias("__last"))
    handed = ends.select(*keys, F.lag("__last").over(Window.partitionBy(*group).orderBy(SLICE)).alias("__handed"))  # one row per slice
    local = sliced.withColumn("__own", F.lag(held).over(Window.partitionBy(*keys).orderBy(*order)))
    left, right = local.alias("l"), handed.alias("r")
    matched = left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    return matched.select(*[F.col(f"l.{c}").alias(c) for c in sliced.columns], F.coalesce("__own", "__handed").alias("__before"))


def previous_by_order(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, before: str) -> DataFrame:
    """``before``: the value of the row before by ascending ``order``, null for a group's first row; one range sort."""
    sliced = _ranged(df, group, [F.col(o) for o in order])
    return _with_previous(sliced, list(group), list(order), value).withColumn(before, F.col("__before.v")).drop("__before", SLICE)


def runs_by_order(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, run: str) -> DataFrame:
    """``run``: the number, from 1, of the row's run of equal values in its group; a null is a run of its own.  One range sort."""
    flagged = _with_previous(_ranged(df, group, [F.col(o) for o in order]), list(group), list(order), value)
    flagged = flagged.withColumn("__s", F.when(F.col("__before.v") == F.col(value), 0).otherwise(1)).drop("__before")
    return _finish(materialise(flagged, "flagged"), list(group), [F.col(o) for o in order], None, "__s", run, None).drop("__s")
