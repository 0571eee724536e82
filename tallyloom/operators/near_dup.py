"""Near-duplicate links and groups from MinHash signatures.

With M hashes and threshold T two signatures may differ in at most
M - ceil(T M) places.  Cut into ``bands`` bands, a true pair must agree on at
least bands - that many whole bands; with two or more guaranteed, banding loses
no pair and the result equals comparing everything with everything.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.minhash import agreement
from ..session import materialise
from .components import connected_components

SMALL = 16  # members of a bucket that are compared without another cut


def _bands(reps: DataFrame, bands: int, m: int) -> DataFrame:
    width = m // bands
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", i * width + 1, width)) for i in range(bands)])
    return reps.select("id", F.posexplode(keys).alias("band", "bk"))


def _scored(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``(a, b, same)``: in how many places the signatures of each pair agree."""
    left = reps.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    right = reps.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", agreement(F.col("sa"), F.col("sb")).alias("same"))


def _around_hubs(members: DataFrame, reps: DataFrame, bucket: list[str], m: int, need: int) -> tuple[DataFrame, DataFrame]:
    """Links of the ``(bucket.., id)`` rows with each bucket's least id, and the rows of the buckets that these leave open.

    Two members that both agree with the hub are connected already.  A bucket is
    open while a member does not agree; its rows come with ``core`` (agrees, or
    is the hub) and ``far``, the number of places in which a row differs from the
    hub.
    """
    hubs = members.groupBy(*bucket).agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = materialise(members.join(hubs, bucket), "members")
    spokes = placed.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    spokes = materialise(_scored(spokes, reps), "spokes")
    far = spokes.select(F.col("a").alias("id"), F.col("b").alias("hub"), (F.lit(m) - F.col("same")).alias("__far"))
    marked = placed.join(far, ["id", "hub"], "left").select(*bucket, "id", "n", F.coalesce("__far", F.lit(0)).alias("far"))
    marked = marked.withColumn("core", F.col("far") <= m - need)
    open_buckets = marked.groupBy(*bucket).agg(F.bool_and("core").alias("__all")).filter("not __all").select(*bucket)
    return spokes.filter(F.col("same") >= need).select("a", "b"), materialise(marked.join(open_buckets, bucket, "left_semi"), "open")


def _cut_anew(open_rows: DataFrame, reps: DataFrame, bucket: list[str], m: int, need: int) -> DataFrame:
    """Members of each open bucket dealt into new buckets that lose no agreeing pair.

    Signatures that agree differ in at most D = m - need places, so of D + 1
    parts of the places at least one agrees whole, however the places are dealt.
    Here each bucket deals its own: places are ranked by how often two members
    agree there and dealt in turn, so every part gets its share of the places in
    which the bucket's members differ most, and members that only share a
    template part.
    """
    parts = m - need + 1
    held = open_rows.select(*bucket, "id").join(reps.select("id", "sig"), "id")
    values = held.select(*bucket, F.posexplode("sig").alias("place", "value")).groupBy(*bucket, "place", "value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    likely = values.groupBy(*bucket, "place").agg(F.sum(F.col("c") * F.col("c")).alias("s"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("s", "place"))), lambda x: x["place"])  # m places
    dealt = likely.groupBy(*bucket).agg(order.alias("order"))

    def key(part: int):
        own = F.filter("order", lambda _, i: i % parts == part)
        return F.xxhash64(F.lit(part), *[F.col(c) for c in bucket], F.transform(own, lambda p: F.get("sig", p)))

    keys = held.join(dealt, bucket).select("id", F.explode(F.array(*[key(p) for p in range(parts)])).alias("bk"))
    return keys.distinct()


def near_duplicate_links(signatures: DataFrame, id_col: str, threshold: float = 0.95, m: int = 128, bands: int = 8) -> DataFrame:
    """Verified links ``(a, b)`` that connect exactly the ids all agreeing pairs would connect.

    Equal signatures hang on their least id.  In each band bucket the members are
    compared with the bucket's least id; two members that both agree with it are
    connected already and need no comparison, so a large group of copies costs
    one comparison per member.  What is left of large buckets, pages of one
    template say, is dealt anew by the places in which its members differ, see
    ``_cut_anew``; what is left of small ones, and of those dealt anew, is
    compared pair by pair, but for pairs whose distances to the hub differ by more
    than a link allows.  Band hashes only choose candidates.
    """
    need = math.ceil(threshold * m - 1e-9)
    if m - need > bands - 2:
        raise ValueError("more bands are needed for this threshold")
    signed = materialise(signatures.select(F.col(id_col).alias("id"), "sig", F.md5(F.array_join("sig", ",")).alias("k")), "signed")
    groups = signed.groupBy("k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = signed.select("id", "k").join(groups.filter("n > 1").select("k", "rep"), "k").filter("id <> rep")
    copies = copies.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = materialise(signed.join(groups.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "sig"), "reps")

    links, rows = _around_hubs(_bands(reps, bands, m).select("bk", "id"), reps, ["bk"], m, need)
    out = copies.unionByName(links)
    large = rows.filter(F.col("n") > SMALL)
    if not large.isEmpty():
        # a pair that agrees shares a first bucket, and there one of the new ones
        links, left = _around_hubs(_cut_anew(large, reps, ["bk"], m, need), reps, ["bk"], m, need)
        out = out.unionByName(links)
        rows = rows.filter(F.col("n") <= SMALL).unionByName(left)
    return out.unionByName(_rest(rows, reps, m, need)).distinct()


def _rest(rows: DataFrame, reps: DataFrame, m: int, need: int) -> DataFrame:
    """Links of the members that do not agree with their bucket's hub with the bucket's others."""
    one = rows.filter("not core").select("bk", F.col("id").alias("x"), F.col("far").alias("fx"))
    two = rows.select("bk", F.col("id").alias("y"), F.col("core").alias("yc"), F.col("far").alias("fy"))
    # two open members meet once, from the larger id; a link's ends are at like distances from the hub
    met = one.join(two, "bk").filter((F.col("x") != F.col("y")) & (F.col("yc") | (F.col("x") > F.col("y"))) & (F.abs(F.col("fx") - F.col("fy")) <= m - need))
    pairs = met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    return _scored(pairs, reps).filter(F.col("same") >= need).select("a", "b")


def near_duplicate_groups(links: DataFrame) -> DataFrame:
    """``(id, group_id, group_size)`` for ids with at least one near duplicate."""
    comps = materialise(connected_components(links).withColumnRenamed("component", "group_id"), "groups")
    sizes = comps.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return comps.join(sizes, "group_id").select("id", "group_id", "group_size")


def mark_duplicates(df: DataFrame, id_col: str, groups: DataFrame) -> DataFrame:
    """Add ``keep`` (least id of the group) and ``weight`` (one over the group size)."""
    marks = groups.select(F.col("id").alias(id_col), "group_id", "group_size")
    joined = df.join(marks, id_col, "left")
    return joined.select(
        *df.columns,
        F.coalesce("group_id", F.col(id_col)).alias("group_id"),
        (F.col("group_id").isNull() | (F.col("group_id") == F.col(id_col))).alias("keep"),
        (F.lit(1.0) / F.coalesce("group_size", F.lit(1))).alias("weight"),
    )


def contaminated(train: DataFrame, bench: DataFrame, threshold: float = 0.95, m: int = 128, bands: int = 8) -> DataFrame:
    """``(train_id)`` of the ``(id, sig)`` rows that agree with a benchmark row in enough places.

    Both sides are reduced to distinct signatures first, and a pair must share
    two bands, so a large group of copies is compared once.
    """
    need = math.ceil(threshold * m - 1e-9)
    if m - need > bands - 2:
        raise ValueError("more bands are needed for this threshold")
    left = materialise(train.select("id", "sig", F.md5(F.array_join("sig", ",")).alias("k")), "train")
    kinds = left.groupBy("k").agg(F.min_by("sig", "id").alias("sig"))
    items = bench.select("sig", F.md5(F.array_join("sig", ",")).alias("bk_id")).groupBy("bk_id").agg(F.first("sig").alias("sig"))

    def two_bands(t: DataFrame, key: str) -> DataFrame:
        width = m // bands
        one = [F.xxhash64(F.lit(i), F.slice("sig", i * width + 1, width)) for i in range(bands)]
        both = [F.xxhash64(one[i], one[j]) for i in range(bands) for j in range(i + 1, bands)]
        return t.select(F.col(key), F.explode(F.array(*both)).alias("bk"))

    candidates = two_bands(kinds, "k").join(two_bands(items, "bk_id"), "bk").select("k", "bk_id").distinct()
    hit = (
        candidates.join(kinds, "k")
        .join(items.withColumnRenamed("sig", "bsig"), "bk_id")
        .filter(agreement(F.col("sig"), F.col("bsig")) >= need)
        .select("k")
        .distinct()
    )
    return left.join(hit, "k", "left_semi").select(F.col("id").alias("train_id"))


def shared_shingles(train: DataFrame, bench: DataFrame, share: float) -> DataFrame:
    """Documents that hold at least ``share`` of a benchmark item's distinct shingles.

    ``(id, shingle)`` tables of distinct rows; pairs without a common shingle are
    left out.  Catches a short passage inside a long document, where whole-text
    signatures cannot agree.

    Shingles that the same items hold count as one: a document has one number per
    set of items, however many shingles and items that is.  An item is a
    candidate for a document only by one of its rarest shingles, as many as it
    can lack and one more, so a shingle that all items hold makes no pairs.
    """
    sizes = bench.groupBy("id").agg(F.count(F.lit(1)).alias("size")).withColumn("need", F.greatest(F.ceil(F.col("size") * share), F.lit(1)))
    held = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x"))
    posted = materialise(bench.join(bench.groupBy("shingle").agg(held.alias("items")), "shingle"), "posted")
    rarest = Window.partitionBy("id").orderBy("items.n", "shingle")
    first = posted.withColumn("nth", F.row_number().over(rarest)).join(sizes, "id").filter(F.col("nth") <= F.col("size") - F.col("need") + 1)
    met = materialise(train.join(posted.select("shingle", "items").distinct(), "shingle").groupBy("id", "items").agg(F.count(F.lit(1)).alias("c")), "met")
    pairs = train.join(first.select("shingle", F.col("id").alias("bench_id")), "shingle").select("id", "bench_id").distinct()
    of_item = posted.select(F.col("id").alias("bench_id"), "items").distinct()
    counted = pairs.join(of_item, "bench_id").join(met, ["id", "items"]).groupBy("id", "bench_id").agg(F.sum("c").alias("common"))
    return counted.join(sizes.withColumnRenamed("id", "bench_id"), "bench_id").filter(F.col("common") >= F.col("need")).select(
        F.col("id").alias("train_id"), "bench_id", "common", "size"
    )


def decontaminate(train: DataFrame, id_col: str, hits: DataFrame) -> DataFrame:
    return train.join(hits.select(F.col("train_id").alias(id_col)).distinct(), id_col, "left_anti")


def trajectory_shingles(events: DataFrame, key: str, order: list[str], step: str, n: int) -> DataFrame:
    """Distinct runs of n consecutive steps per key: ``(key, shingle)``.

    Each step is sent to the n runs it belongs to by its rank, so a key with very
    many events is spread over all tasks; a key with fewer steps is one run.
    """
    from ..functions.ordering import rank_by_order

    ranked = rank_by_order(events.select(key, *order, step), [key], order, rank="__r", total="__t")
    last = F.greatest(F.col("__t") - n + 1, F.lit(1))
    starts = F.sequence(F.greatest(F.col("__r") - n + 1, F.lit(1)), F.least(F.col("__r"), last))
    runs = ranked.select(key, "__r", step, F.explode(starts).alias("__s"))
    parts = F.array_sort(F.collect_list(F.struct("__r", step)))  # n steps
    joined = runs.groupBy(key, "__s").agg(F.array_join(F.transform(parts, lambda p: p[step]), " ").alias("shingle"))
    return joined.select(key, "shingle").distinct()
