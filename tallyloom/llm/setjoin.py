"""N-gram Jaccard join: size-aware, with subsets for small sets and inverted lists for large ones.

A text's set holds the distinct runs of ``k`` words.  Equal sets are one class;
one row stands for it.  Two classes link when their Jaccard similarity is at
least ``percent`` / 100, which needs c(m, n) = ceil(percent (m + n) / (100 +
percent)) common elements.

- A light set (size up to the boundary) is posted under every subset of c(m, n)
  elements, for each partner size n that can link; linked light sets share one.
- A heavy set, and a light one that is large enough to meet a heavy one, is
  posted under its m - ceil(percent m / 100) + e first elements in an order that
  puts frequent elements last; linked sets share e of those, so a set that shares
  fewer with all others together leaves the lists.
- The boundary is the largest size up to which subsets cost less than lists.
  The order of the elements and the boundary decide the cost, never the result.

Every list is compared with its first member; sets that link with it are one
component already and are not compared with each other.  What is left of a list
gets further centres while its open pairs are many and that joins components,
then its remaining members of different components meet, in bands of similar
size and behind an upper bound of their overlap.  Every candidate is verified on
the whole texts.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import materialise, scratch
from . import kernels as K
from .registry import register, table

SHINGLE = 3
PERCENT = 90
ORDERED = 1 << 17  # the most frequent elements whose order is known: bounds what is broadcast
LIGHTEST = 64  # subsets are never enumerated for larger sets
BUCKETS = 64  # of the count vector that bounds an overlap from above
MOST = 32767  # that a count holds; sets that reach it are not bounded
BLOCK = 4_000_000  # elements counted together
BROADCAST = 500_000  # rows of four numbers that are sent to all executors at most
SHORT = 64  # members of a list up to which they are not parted into bands of similar size
FEW_PAIRS = 64  # open pairs per list member from which on more centres pay
BEFORE = 16  # lists of a set before each of its lists that are known there: a pair that shares one has met


def common_needed(m: int, n: int, percent: int) -> int:
    return -(-percent * (m + n) // (100 + percent))


def subset_sizes(m: int, percent: int) -> list[int]:
    """The subset sizes under which a light set of size m must be posted."""
    partners = range(-(-percent * m // 100), 100 * m // percent + 1)
    return sorted({c for n in partners if (c := common_needed(m, n, percent)) <= min(m, n)})


def subset_count(m: int, percent: int) -> int:
    return sum(math.comb(m, c) for c in subset_sizes(m, percent))


def prefix_size(m: int, percent: int) -> int:
    return m - -(-percent * m // 100) + 1


def shared_needed(m: int, percent: int) -> int:
    """How many of their first elements two linked sets of sizes from m on share at least."""
    return 1 + prefix_size(m, percent) // 2


def distinct_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text, block by block of texts."""
    for _, _, data, offsets in K.chunks(column):
        start, stop, first = K.words(K.LOWER[data], offsets)
        values, at = K.shingle_hashes(K.word_hashes(K.LOWER[data], start, stop), first, k)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            v = np.sort(values[a:b])
            out.append(v[np.concatenate([[True], v[1:] != v[:-1]])] if b > a else v)
        yield out


def signature(v: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a = K.mix64(v ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(K.mix64(v * np.uint64(K.BASE) + np.uint64(1))) if len(v) else np.uint64(0)
    return int(a.astype(np.int64)), int(np.uint64(b).astype(np.int64))


COUNTED = pa.schema([("size", pa.int32()), ("element", pa.int64()), ("n", pa.int64())])


def count_elements(texts: DataFrame, k: int) -> DataFrame:
    """``(size, element, n)``: sets by size up to LIGHTEST (0: larger), and elements that repeat among a block's texts."""

    def count(batches):
        def flush(held, sizes, total):
            v, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = n >= max(4, int(sizes.sum()) // 1000)
            at = np.flatnonzero(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([at, [-1], np.full(keep.sum(), -2)]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(at) + 1, np.int64), v[keep].astype(np.int64)])),
                    pa.array(np.concatenate([sizes[at], [total], n[keep]]).astype(np.int64)),
                ],
                schema=COUNTED,
            )

        held, sizes, total = [], np.zeros(LIGHTEST + 1, np.int64), 0
        for batch in batches:
            for sets in distinct_sets(batch.column(0), k):
                for v in sets:
                    sizes[len(v) if len(v) <= LIGHTEST else 0] += len(v) > 0
                    total += len(v)
                held += sets
                if sum(map(len, held)) > BLOCK:
                    yield from flush(held, sizes, total)
                    held, sizes, total = [], np.zeros(LIGHTEST + 1, np.int64), 0
        yield from flush(held, sizes, total)

    rows = texts.mapInArrow(count, "size int, element long, n long")
    return rows.groupBy("size", "element").agg(F.sum("n").alias("n"))


def light_boundary(sizes: dict[int, int], mean_list: float, percent: int) -> int:
    """The largest size up to which subsets cost less than scanning lists of ``mean_list`` members, over the sets there are."""
    best, saved, at = 0.0, 0.0, 0
    for m in range(1, LIGHTEST + 1):
        saved += sizes.get(m, 0) * (prefix_size(m, percent) * (1 + mean_list) - subset_count(m, percent))
        if saved > best:
            best, at = saved, m
    return at


def posted(rows: DataFrame, k: int, percent: int, boundary: int, order: np.ndarray) -> DataFrame:
    """``(doc_id, text_hash, n, s1, s2, counts, posts)`` of the ``(doc_id, text_hash, text)`` rows; ``order``: frequent elements, most frequent last."""
    shared = rows.sparkSession.sparkContext.broadcast(order)
    least = -(-percent * (boundary + 1) // 100)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("counts", pa.list_(pa.int16())), ("posts", pa.list_(pa.int64()))]
    )

    def post(batches):
        order = shared.value
        by_value = np.argsort(order)
        listed = order[by_value]
        maybe = np.zeros(1 << 20, bool)
        maybe[(listed >> np.uint64(44)).astype(np.int64)] = True

        def first_elements(v):
            size = prefix_size(len(v), percent) + shared_needed(len(v), percent) - 1
            late = maybe[(v >> np.uint64(44)).astype(np.int64)]
            if late.any():
                at = np.flatnonzero(late)
                where = np.minimum(np.searchsorted(listed, v[at]), len(listed) - 1)
                hit = listed[where] == v[at]
                late[at[~hit]] = False
                rank = by_value[where[hit]]
                v = np.concatenate([v[~late], v[late][np.argsort(rank)]])
            return v[:size]

        def subsets(v):
            m, mixed = len(v), K.mix64(v + np.uint64(7))
            whole = mixed.sum(dtype=np.uint64)
            for c in subset_sizes(m, percent):
                left = np.array(list(itertools.combinations(range(m), m - c)), np.int64)
                yield whole - mixed[left].sum(axis=1, dtype=np.uint64) + K.mix64(np.array([c], np.uint64))

        for batch in batches:
            i = 0
            for sets in distinct_sets(batch.column(2), k):
                posts, signed = [], [signature(v) for v in sets]
                for v in sets:
                    p = [first_elements(v)] if len(v) >= max(least, 1) else []
                    if 0 < len(v) <= boundary:
                        p.append(K.mix64(np.concatenate(list(subsets(v)))))
                    posts.append(np.concatenate(p) if p else np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, len(sets)),
                        batch.column(1).slice(i, len(sets)),
                        pa.array([len(v) for v in sets], pa.int32()),
                        pa.array([s[0] for s in signed], pa.int64()),
                        pa.array([s[1] for s in signed], pa.int64()),
                        K.lists([np.minimum(np.bincount((v >> np.uint64(58)).astype(np.int64), minlength=BUCKETS), MOST) for v in sets], pa.int16()),
                        K.lists([p.astype(np.int64) for p in posts], pa.int64()),
                    ],
                    schema=schema,
                )
                i += len(sets)

    return rows.mapInArrow(post, "doc_id long, text_hash long, n int, s1 long, s2 long, counts array<smallint>, posts array<long>")


def elements_of(rows: DataFrame, k: int) -> DataFrame:
    """``(node, elements)`` of the ``(node, s1, s2, text)`` rows whose text has the set with that signature."""

    def fetch(batches):
        for batch in batches:
            i = 0
            for sets in distinct_sets(batch.column(3), k):
                part = batch.slice(i, len(sets))
                same = [signature(v) == (a, b) for v, a, b in zip(sets, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).filter(pa.array(same)), K.blobs([v for v, ok in zip(sets, same, strict=True) if ok])], names=["node", "elements"]
                )
                i += len(sets)

    return rows.mapInArrow(fetch, "node long, elements binary").dropDuplicates(["node"])


def linked(pairs: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of the ``(a, b, ea, eb)`` rows whose sets are similar enough."""

    def test(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(test, "a long, b long")


def _possible(percent: int) -> Column:
    """Sizes and counts of the two sets leave room for enough common elements."""
    least = F.zip_with("ca", "cb", lambda x, y: F.least(x, y))
    common = F.aggregate(least, F.lit(0), lambda s, x: s + x)
    room = (common * (100 + percent) >= (F.col("na") + F.col("nb")) * percent) | (F.least("na", "nb") >= MOST)
    return _similar_sizes(percent) & room


def _similar_sizes(percent: int) -> Column:
    return F.least("na", "nb").cast("bigint") * 100 >= F.greatest("na", "nb").cast("bigint") * percent


def set_components(docs: DataFrame, doc_id: str, text: str, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id, stays)``, one row per row of ``docs``.

    ``stays`` is true for one row of each component, one with its least id, and
    for rows without a set; ``text_hash`` is ``xxhash64`` of the text.

    ``component_id`` is the least ``doc_id`` reachable by links, the row's own
    included.  A null or empty text, or one of white space only, has no set and
    links with nothing.  Equal rows are one class.  A row without ``doc_id``
    carries links but no name: its own component is the least id of the others,
    or null.  Other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    with scratch(docs.sparkSession) as keep:
        return keep(_components(source, k, percent), "set_components")


def _components(source: DataFrame, k: int, percent: int) -> DataFrame:
    counted = materialise(count_elements(source.select("text"), k), "elements")
    sizes = {r["size"]: r["n"] for r in counted.filter("size > 0").select("size", "n").collect()}
    total = counted.filter("size = -1").agg(F.sum("n")).first()[0] or 0
    repeated = counted.filter("size = -2")
    scanned = repeated.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    often = repeated.orderBy(F.col("n").desc(), "element").limit(ORDERED).select("element").collect()
    order = np.array([r[0] for r in reversed(often)], np.int64).astype(np.uint64)
    boundary = light_boundary(sizes, 1 + scanned / max(total, 1), percent)

    rows = materialise(posted(source, k, percent, boundary, order).withColumn("row", F.monotonically_increasing_id()), "posted")
    named_row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    kinds = rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("node"), F.min(named_row).alias("least"))
    kinds = materialise(kinds, "kinds")
    nodes = rows.join(kinds.select(F.col("node").alias("row")), "row").drop("doc_id", "text_hash")
    nodes = materialise(nodes.withColumnRenamed("row", "node"), "nodes")
    about = nodes.select("node", "n", "counts")
    posts = nodes.select("node", "n", F.explode("posts").alias("key"))

    def listed(posts: DataFrame) -> DataFrame:
        lists = posts.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("len")).filter("len > 1")
        return posts.join(lists, "key")

    shared = materialise(listed(posts).drop("hub"), "shared")
    least_partner = F.ceil(F.col("n") * percent / 100)
    first = F.col("n") - least_partner + 1  # prefix_size, as a column
    needed = 1 + F.floor((least_partner - F.ceil(least_partner * percent / 100) + 1) / 2)  # shared_needed of the least partner
    heavy = F.col("n") > boundary
    enough = shared.groupBy("node", "n").agg(F.count(F.lit(1)).alias("c"))
    enough = enough.withColumn("spare", F.when(heavy, F.col("c") - needed).otherwise(F.col("c"))).filter("spare >= 0")
    # posted elements that no other set has posted
    enough = enough.withColumn("alone", F.when(heavy, F.least(first + F.floor(first / 2), F.col("n")) - F.col("c")))
    # of c shared elements, of which a partner has all but ``spare``, the spare + 1 in the shortest lists meet it
    nth = F.row_number().over(Window.partitionBy("node").orderBy("len", "key"))
    few = shared.join(enough.select("node", "spare", "alone"), "node").withColumn("nth", nth).filter("nth <= spare + 1")
    # elements that a partner lacks whose first common list this is, see ``_meet``
    few = few.withColumn("lacks", F.coalesce(F.col("alone") + F.col("nth") - 1, F.lit(0)).cast("int"))
    members = materialise(listed(few.select("node", "n", "key", "lacks")).drop("len"), "members")

    seen = fetched = None

    def verify(pairs: DataFrame) -> DataFrame:
        """Links among the ``(a, na, b, nb)`` pairs."""
        nonlocal seen, fetched
        sized = pairs.filter(_similar_sizes(percent)).join(about.select(F.col("node").alias("a"), F.col("counts").alias("ca")), "a")
        sized = sized.join(about.select(F.col("node").alias("b"), F.col("counts").alias("cb")), "b")
        pairs = sized.filter(_possible(percent)).select("a", "b")
        pairs = materialise(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        seen = pairs if seen is None else seen.unionByName(pairs)
        need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if fetched is not None:
            need = need.join(fetched.select("node"), "node", "left_anti")
        need = need.join(nodes.select("node", "s1", "s2"), "node").join(rows.select(F.col("row").alias("node"), "doc_id"), "node")
        at = need.select("node", "s1", "s2", F.col("doc_id").alias("__id"))
        at = materialise(at, "needed")
        n = at.count()
        if fetched is None or n:
            # few sets: their texts are picked in the scan, else both sides are shuffled
            few = F.broadcast(at) if n <= BROADCAST else at
            texts = few.join(source, F.col("__id").eqNullSafe(F.col("doc_id"))).select("node", "s1", "s2", "text")
            new = materialise(elements_of(texts, k), "sets")
            fetched = new if fetched is None else fetched.unionByName(new)
        both = pairs.join(fetched.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a")
        both = both.join(fetched.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
        return materialise(linked(both.select("a", "b", "ea", "eb"), percent), "links")

    size_of = about.select(F.col("node").alias("hub"), F.col("n").alias("nb"))
    starts = members.filter("node <> hub").select("node", "n", "hub").distinct().join(size_of, "hub")
    labels = connected_components(verify(starts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hub").alias("b"), "nb")))
    open_lists, joined = members.withColumnRenamed("hub", "done"), True
    while True:
        # a list is settled when its members, without centres that met all others, are of one component
        named = open_lists.filter("node <> done").drop("done").join(labels.withColumnRenamed("id", "node"), "node", "left")
        named = named.withColumn("component", F.coalesce("component", "node"))
        shares = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("node", "n")).alias("hub"))
        c = F.col("c").cast("double")
        spread = shares.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.min_by("hub", "component").alias("hub"), F.sum(c).alias("all"), F.sum(c * c).alias("same")
        )
        spread = spread.filter("lo < hi").withColumn("pairs", (F.col("all") * F.col("all") - F.col("same")) / 2)
        named = named.join(spread, "key").select("key", "node", "n", "lacks", "component", "hub", "lo", "all", (F.col("pairs") / F.col("all")).alias("share"))
        named = materialise(named, "open")
        size, pairs = named.agg(F.count(F.lit(1)), F.sum("share")).first()
        if not joined or (pairs or 0) <= FEW_PAIRS * size:
            break
        a, b = F.struct("node", "n"), F.col("hub")
        star = named.filter("component <> lo").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
        star = star.select(F.col("a.node").alias("a"), F.col("a.n").alias("na"), F.col("b.node").alias("b"), F.col("b.n").alias("nb"))
        labels, joined = _joined(labels, verify(star))
        open_lists = named.select("node", "n", "key", "lacks", F.col("hub.node").alias("done"))

    if not named.isEmpty():
        band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9)
        before = Window.partitionBy("node").orderBy("lacks", "key").rowsBetween(-BEFORE, -1)
        known = named.select("key", "node", "component", "n", "lacks", "all", F.collect_list("key").over(before).alias("met")).join(about.select("node", "counts"), "node")
        known = known.withColumn("own", F.when(F.col("all") > SHORT, band).otherwise(0)).select("key", "node", "component", "n", "lacks", "counts", "all", "met", "own")
        short = known.filter(F.col("all") <= SHORT).withColumn("band", F.col("own"))
        long = known.filter(F.col("all") > SHORT).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
        labels, _ = _joined(labels, verify(_meet(short.unionByName(long), percent).distinct()))
    of = kinds.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of.groupBy("component").agg(F.min("least").alias("first"))
    of = of.join(least, "component").select("s1", "s2", "n", "first")
    out = rows.select("doc_id", "text_hash", "row", "n", "s1", "s2").join(of, ["s1", "s2", "n"], "left")
    mine = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    stays = (F.col("n") == 0) | (F.col("row") == F.col("first.row"))
    return out.select("doc_id", "text_hash", F.col("n").cast("bigint").alias("n_shingles"), mine.alias("component_id"), stays.alias("stays"))


def _joined(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """``labels`` with the components that new links join, and whether any do; only the links' components are contracted."""
    of = labels.select("id", "component")
    for side in ("a", "b"):
        links = links.join(of.select(F.col("id").alias(side), F.col("component").alias(f"__{side}")), side, "left")
    links = links.select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b")).filter("a <> b").distinct()
    links = materialise(links, "joins")
    if links.isEmpty():
        return labels, False
    step = connected_components(links)
    moved = of.join(step.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    new = step.join(of.select("id"), "id", "left_anti")
    return materialise(moved.select("id", F.coalesce("to", "component").alias("component")).unionByName(new), "labels"), True


def one_of_each(docs: DataFrame, doc_id: str, text: str, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and those without a set.

    Of rows that share id and text the one whose columns have the least hash
    stays.  Null and empty texts, and those of white space only, have no set and
    all stay.
    """
    with scratch(docs.sparkSession) as keep:
        found = set_components(docs, doc_id, text, k, percent).filter("n_shingles > 0")
        found = found.groupBy(F.struct("doc_id", "text_hash").alias("__key")).agg(F.max("stays").alias("stays"), (F.count(F.lit(1)) > 1).alias("__many"))
        stay = keep(found.filter("stays").drop("stays"), "stay")
    key = F.struct(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"))
    keyed = docs.select(key.alias("__key"), F.struct(*docs.columns).alias("__row"), F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("__set"))
    kept = keyed.filter("__set").join(stay, "__key")
    copies = kept.filter("__many").groupBy("__key").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
    rows = keyed.filter("not __set").select("__row").unionByName(kept.filter("not __many").select("__row")).unionByName(copies.select("__row"))
    return rows.select("__row.*")


def _meet(banded: DataFrame, percent: int) -> DataFrame:
    """``(a, na, b, nb)`` of different components in one list and band that may link; a pair may come several times.

    In the first list that two linked sets share, in the common order of the
    lists, each has ``lacks`` posted elements that the other has not posted.  The
    one whose posted elements end earlier holds none of them in the other, so
    either set has enough elements left for the link.

    A pair that shares one of the lists before this one, ``met``, meets there,
    where it lacks less; so it is left out here, and sets that share hundreds of
    lists make a few rows.  The first list of a pair has none before it.
    """

    def side(x: str) -> DataFrame:
        names = {"node": x, "component": f"p{x}", "n": f"n{x}", "lacks": f"l{x}", "counts": f"c{x}", "met": f"m{x}", "own": f"o{x}"}
        return banded.select("key", "band", *[F.col(c).alias(name) for c, name in names.items()])

    left_over = F.greatest(F.col("na") - F.col("la"), F.col("nb") - F.col("lb")).cast("bigint")
    room = left_over * (100 + percent) >= (F.col("na") + F.col("nb")).cast("bigint") * percent
    once = F.col("band") == F.greatest("oa", "ob")  # neighbouring bands share one, equal ones two
    different = (F.col("a") > F.col("b")) & (F.col("pa") != F.col("pb"))
    met = side("a").join(side("b"), ["key", "band"]).filter(different & once & room & _possible(percent) & ~F.arrays_overlap("ma", "mb"))
    return met.select("a", "na", "b", "nb")


@register("op7_jaccard_join")
def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return set_components(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_shingles", "component_id")
