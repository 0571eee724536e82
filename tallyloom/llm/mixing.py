"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Native: DataFrame functions only.

1. Every source gets a target number of words: its weight's share of the budget,
   at most ``cap`` times its own words; what is above is shared anew by weight.
2. The shuffled documents of a source are laid end to end (again from the start
   after the last one) and cut into blocks of ``block`` words, as many as the
   target needs; the last one is cut at the target.
3. The van der Corput points k = 0, 1, 2, ... (their bits reversed) are mapped
   through the cumulative block counts: the point's interval names the source of
   slot k.  The r-th slot of a source takes the r-th block, so every prefix of
   the schedule holds each source within a few blocks of its share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import rank_by_hash, rank_by_order
from ..functions.stable import stable_hash, stable_hash_sql
from ..session import materialise
from .registry import register, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix over words of the corpus
CAP = 2.0  # words of a source in the mix over its own
BLOCK = 2048
CELL = 4096  # positions of the schedule that are looked up together
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> DataFrame:
    """``(source, source_no, source_size, weight, target)`` of the ``(source, size)`` rows.

    ``source_no`` counts sources by code point, null last; weights repeat in that
    order.  Without rows the result is empty; a source of no words has target 0.
    Only two sums per round reach the driver, however many sources there are.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    per = rank_by_order(per, [], [F.col("source").asc_nulls_last()], rank="source_no")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    at = (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int")
    per = materialise(per.withColumn("weight", F.element_at(listed, at)), "sources")
    most = F.col("source_size") * F.lit(float(cap))

    words, level, stopped = None, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > most
        row = per.agg(
            F.sum("source_size").alias("words"),
            F.count(F.when(above, 1)).alias("stopped"),
            F.sum(F.when(above, most)).alias("held"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
        ).first()
        words = row["words"] or 0
        if row["stopped"] == stopped and level > 0 or not words or row["open"] is None:
            break
        stopped = row["stopped"]
        level = (share * words - (row["held"] or 0.0)) / row["open"]
    reached = F.col("weight") * F.lit(level)
    return per.withColumn("target", F.when(reached > most, most).otherwise(reached) if level > 0 else most * 0)


def schedule(quotas: DataFrame) -> DataFrame:
    """``(slot, source_no, rank)``: which source slot k takes its next block from.

    ``quotas`` holds ``(source_no, n_blocks, upto)``, ``upto`` being the running
    sum of the block counts.
    """
    spark = quotas.sparkSession
    total = quotas.agg(F.max("upto")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    points = spark.range(0, (1 << bits) if total else 0).withColumnRenamed("id", "slot")
    mirrored = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("bigint")
    points = points.withColumn("at", mirrored).filter(F.col("at") < total)
    points = points.withColumn("cell", F.floor(F.col("at") / CELL))
    spans = quotas.filter("n_blocks > 0").select("source_no", (F.col("upto") - F.col("n_blocks")).alias("from"), "upto")
    cells = F.sequence(F.floor(F.col("from") / CELL), F.floor((F.col("upto") - 1) / CELL))
    spans = spans.select("*", F.explode(cells).alias("cell"))
    named = points.join(spans, "cell").filter("at >= `from` and at < upto").select("slot", "source_no")
    return rank_by_hash(named, ["source_no"], "slot", [], rank="rank", slice_bits=16)


def mix(
    docs: DataFrame,
    text: Column,
    source: Column,
    key: Column,
    carry: Sequence[str],
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    block: int = BLOCK,
    seed: str = SEED,
) -> tuple[DataFrame, DataFrame]:
    """The mix as ``(rows, takes)``.

    ``rows``: every row of ``docs`` with the ``carry`` columns, ``row_id``,
    ``size`` (words), ``source_size``, ``target``.  ``takes``: the mix itself, one
    row for each part of a document in a block: ``(slot, row_id, pass, start,
    words)``; ``start`` counts words from the document's first.

    Null or empty texts have size 0 and are never taken; a null source is a source
    of its own, the last; equal rows are rows of their own; an empty table gives
    empty results; other columns are ignored.  The order within a source hashes
    ``key``, so reruns agree.
    """
    narrow = docs.select(
        *carry,
        source.alias("__source"),
        word_count(text).alias("__size"),
        key.alias("__key"),
        stable_hash(F.coalesce(key.cast("string"), F.lit("")), seed).alias("__h"),
    )
    sized = materialise(narrow.withColumn("__row", F.monotonically_increasing_id()), "sized")
    targets = source_targets(sized.select(F.col("__source").alias("source"), F.col("__size").alias("size")), weights, share, cap)
    quota = F.least(F.round("target"), F.floor(F.col("source_size") * F.lit(float(cap)))).cast("bigint")
    targets = targets.withColumn("quota", quota).withColumn("n_blocks", F.ceil(F.col("quota") / block))
    targets = materialise(rank_by_order(targets, [], ["source_no"], rank=None, amount="n_blocks", running="upto"), "targets")

    known = targets.withColumnRenamed("source", "__s")
    placed = sized.join(known, F.col("__source").eqNullSafe(F.col("__s")))
    rows = placed.select(*carry, F.col("__row").alias("row_id"), F.col("__size").alias("size"), "source_size", "target")

    line = placed.filter("__size > 0 and quota > 0").select("__row", "__key", "__h", F.col("__size").alias("size"), "source_no", "source_size", "quota")
    line = rank_by_hash(line, ["source_no"], "__h", ["__key", "__row"], rank=None, amount="size", running="end", slice_bits=12)
    passes = F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("source_size")))
    line = line.select("*", F.explode(passes).alias("pass"))
    begin = F.col("pass") * F.col("source_size") + F.col("end") - F.col("size")
    line = line.withColumn("b", begin).withColumn("e", F.least(F.col("b") + F.col("size"), F.col("quota"))).filter("b < e")
    numbers = F.sequence(F.floor(F.col("b") / block), F.floor((F.col("e") - 1) / block))
    parts = line.select("__row", "source_no", "pass", "b", "e", F.explode(numbers).alias("block"))
    start = F.greatest(F.col("b"), F.col("block") * block)
    stop = F.least(F.col("e"), (F.col("block") + 1) * block)
    parts = parts.select(
        F.col("__row").alias("row_id"), "source_no", "pass", "block", (start - F.col("b")).alias("start"), (stop - start).alias("words")
    )
    slots = schedule(targets.select("source_no", "n_blocks", "upto")).select("slot", "source_no", (F.col("rank") - 1).alias("block"))
    takes = parts.join(slots, ["source_no", "block"]).select("slot", "row_id", "pass", "start", "words")
    return rows, takes


def taken(rows: DataFrame, takes: DataFrame) -> DataFrame:
    """``rows`` with ``taken``, the words that the mix takes of each, repeats counted."""
    sums = takes.groupBy("row_id").agg(F.sum("words").cast("bigint").alias("taken"))
    return rows.join(sums, "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint"))).drop("row_id")


OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
), r AS (  -- by the level at which a source stops, with what the sources stopped before it hold
  SELECT *, 2.0::DOUBLE * source_size AS most, sum(source_size) OVER () AS words,
         coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open
  FROM s WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min((1.5::DOUBLE * words - held) / open, most / w) FILTER (WHERE (1.5::DOUBLE * words - held) / open * w <= most) AS level FROM r
), t AS (
  SELECT source, source_size, CASE WHEN w * level > most THEN most ELSE w * level END AS target FROM r, l
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(round(t.target), 2 * t.source_size)::BIGINT AS quota,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY {stable_hash_sql("coalesce(d.doc_id::VARCHAR, '')", SEED)}, d.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (greatest(least(upto, quota) - (upto - size), 0) + greatest(least(upto + source_size, quota) - (upto - size + source_size), 0))::BIGINT AS taken
FROM o"""


@register("op1_mix_sources", OP1_SQL)
def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, takes = mix(docs, F.col("text"), F.col("source"), F.col("doc_id"), ["doc_id"])
    return taken(rows, takes)
