"""Corpus preparation: checks, exact dedup, length profiles, packing, indexes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import rank_by_order
from ..functions.stable import stable_hash
from ..functions.tokens import tokens_of

# fixed values: the white space that normalisation collapses
SPACE_RUN = r"[ \t\u000B\f 　]+"


def validate_schema(df: DataFrame, rules: Mapping[str, Column], repairs: Mapping[str, Column] | None = None) -> DataFrame:
    """Add ``errors``, the names of the rules a row breaks, after applying repairs.

    A rule is a condition that must hold; null counts as broken.
    """
    for name, value in (repairs or {}).items():
        df = df.withColumn(name, value)
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("errors", F.array_compact(F.array(*broken)))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows to quarantine."""
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def quarantine_bad_json(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parse a JSON string column; unparsable rows keep their raw text and a reason."""
    raw = F.col(column)
    bare = F.regexp_replace(raw, r'"(?:\\.|[^"\\])*"', "")  # brackets inside strings do not count
    opened = F.length(F.regexp_replace(bare, r"[^{\[]", ""))
    closed = F.length(F.regexp_replace(bare, r"[^}\]]", ""))
    # the parser stops after the first whole value, so text behind it is found by the depth
    nesting = F.aggregate(
        F.split(F.regexp_replace(bare, r"[^{}\[\]]", ""), ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("ends")),
        lambda s, c: F.struct(
            (s["depth"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("depth"),
            (s["ends"] + F.when(c.isin("}", "]") & (s["depth"] == 1), 1).otherwise(0)).alias("ends"),
        ),
    )
    one_value = F.when(opened + closed > 0, (nesting["ends"] == 1) & bare.rlike(r"[}\]]\s*$")).otherwise(True)
    reason = (
        F.when(raw.isNull() | (F.trim(raw) == ""), "empty")
        .when(raw.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "control character")
        .when(opened > closed, "truncated")
        .when(opened != closed, "unbalanced brackets")
        .otherwise("syntax")
    )
    parsed = df.withColumn("parsed", F.from_json(raw, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    ok = raw.isNotNull() & F.expr(f"try_parse_json({column}) is not null") & F.col("parsed").isNotNull()
    ok = ok & (opened == closed) & one_value
    tagged = parsed.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    return tagged.filter("__ok").drop("__ok"), tagged.filter("not __ok").withColumn("reason", reason).drop("__ok", "parsed")


def normalize_for_hash(text: Column) -> Column:
    """Unify newlines, collapse runs of spaces, trim line ends and blank lines."""
    unified = F.regexp_replace(text, r"\r\n?", "\n")
    spaced = F.regexp_replace(unified, SPACE_RUN, " ")
    lines = F.regexp_replace(spaced, r" *\n *", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r"\n+", "\n"), r"^\n|\n$", ""))


def exact_dedup(df: DataFrame, id_col: str, value: Column) -> DataFrame:
    """Keep the least id per value.

    The survivors come from a partially combined ``min``, so a value held by a
    third of the rows never meets in one task.
    """
    keep = df.groupBy(F.sha2(value, 256).alias("__h")).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(keep, id_col, "left_semi")


def length_profile(df: DataFrame, group: str, length: str) -> DataFrame:
    """Count, mean, exact P50/P90/P99 and maximum of a length column per group."""
    p = F.percentile(F.col(length), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean"), p.alias("__p"), F.max(length).cast("bigint").alias("longest")
    ).select(group, "n", "mean", *[F.col("__p")[i].alias(f"p{q}") for i, q in enumerate((50, 90, 99))], "longest")


def length_histogram(df: DataFrame, length: str, low: float, high: float, bins: int) -> DataFrame:
    bucket = F.width_bucket(F.col(length).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def truncate_tokens(tokens: Column, limit: Column | int, head: Column | int = 0) -> Column:
    """Keep the first ``head`` tokens (the instruction) and then the latest context up to ``limit``."""
    limit, head = (F.lit(x) if isinstance(x, int) else x for x in (limit, head))
    tail = F.greatest(limit - head, F.lit(0))
    cut = F.concat(F.slice(tokens, F.lit(1), head), F.slice(tokens, F.size(tokens) - tail + 1, tail))
    return F.when(F.size(tokens) <= limit, tokens).otherwise(cut)


def truncation_rate(df: DataFrame, group: str, length: str, limit: int) -> DataFrame:
    over = F.col(length) > limit
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(over).alias("cut"), F.avg(over.cast("double")).alias("rate")
    )


def diagnostic_sample(df: DataFrame, id_col: str, n: int, seed: int, group: str | None = None) -> DataFrame:
    """The n rows with the least hash, overall or per group: stable under any layout."""
    hashed = df.withColumn("sample_key", stable_hash(F.col(id_col), seed))
    if group is None:
        return hashed.orderBy("sample_key", id_col).limit(n)
    order = Window.partitionBy(group).orderBy("sample_key", id_col)
    # the rank filter is also applied before the shuffle, so a group sends n rows per task at most
    return hashed.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= n).drop("__rn")


def sample_frame(df: DataFrame, n: int, seed: int, version: str, rules: Sequence[str]) -> DataFrame:
    """One row that records how a sample was drawn."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.current_timestamp().alias("taken_at"),
        F.lit(version).alias("data_version"),
        F.lit(seed).alias("seed"),
        F.lit(n).alias("wanted"),
        "rows",
        F.array(*[F.lit(r) for r in rules]).cast("array<string>").alias("rules"),
    )


def dataset_profile(df: DataFrame, group: str, text: str) -> DataFrame:
    """Rows, characters, tokens, mean length and empty texts per subset."""
    n_tokens = F.size(tokens_of(F.col(text)))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.length(text)).cast("bigint").alias("chars"),
        F.sum(n_tokens).cast("bigint").alias("tokens"),
        F.avg(n_tokens).alias("mean_tokens"),
        F.count_if(n_tokens == 0).alias("empty"),
    )


def length_buckets(df: DataFrame, length: str, edges: Sequence[int]) -> DataFrame:
    """Number of the length bucket; write with ``repartitionByRange`` to batch like lengths."""
    number = F.lit(0)
    for e in edges:
        number = number + (F.col(length) >= e).cast("int")
    return df.withColumn("bucket", number)


def length_ntiles(df: DataFrame, length: str, id_col: str, n: int) -> DataFrame:
    """Equal-count length buckets from a distributed rank: the rule of ``ntile``."""
    ranked = rank_by_order(df, [], [length, id_col], rank="__r", total="__t")
    small = F.expr(f"__t div {n}")
    extra = F.expr(f"__t % {n}")
    edge = extra * (small + 1)
    tile = F.when(F.col("__r") <= edge, F.ceil(F.col("__r") / (small + 1))).otherwise(
        extra + F.ceil((F.col("__r") - edge) / F.greatest(small, F.lit(1)))
    )
    return ranked.withColumn("bucket", tile.cast("int")).drop("__r", "__t")


def pack_tokens(df: DataFrame, shard: str, order: str, tokens: str, rows: int, length: int, ranks: int) -> DataFrame:
    """Cut each shard's token stream into (x, y) blocks of rows x length tokens.

    y is x shifted by one, so a block reads one token of the next.  Blocks go to
    ranks in turn; a rank goes on while a whole stride is left, the tail is dropped.
    ``order`` is unique within a shard.  Offsets come from the narrow table of
    lengths, and a row sends each block one slice of its tokens.
    """
    size = rows * length
    sized = df.select(shard, order, F.col(tokens).alias("__t"), F.size(tokens).cast("bigint").alias("__n"))
    placed = rank_by_order(sized.drop("__t"), [shard], [order], rank=None, amount="__n", running="__end")
    totals = sized.groupBy(shard).agg(F.sum("__n").alias("__len"))
    begin = (F.col("__end") - F.col("__n")).alias("__o")
    at = sized.filter("__n > 0").join(placed.select(shard, order, begin, "__end"), [shard, order])
    # a block takes one token more, the first of the next
    first = F.greatest(F.expr(f"(__o - 1) div {size}"), F.lit(0))
    met = at.select(shard, "__o", "__end", "__t", F.explode(F.sequence(first, F.expr(f"(__end - 1) div {size}"))).alias("block"))
    start = F.greatest(F.col("__o"), F.col("block") * size)
    stop = F.least(F.col("__end"), F.col("block") * size + size + 1)
    piece = F.slice("__t", (start - F.col("__o") + 1).cast("int"), (stop - start).cast("int"))
    parts = met.select(shard, "block", F.struct(start.alias("k"), piece.alias("w")).alias("part"))
    blocks = parts.groupBy(shard, "block").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["w"])).alias("__ws")
    )  # at most size + 1 tokens
    whole = blocks.filter(F.size("__ws") == size + 1).join(totals, shard)
    stays = (F.col("block") < ranks) | ((F.col("block") + ranks) * size + 1 <= F.col("__len"))
    return whole.filter(stays).select(
        shard,
        "block",
        (F.col("block") % ranks).cast("int").alias("rank"),
        F.slice("__ws", 1, size).alias("x"),
        F.slice("__ws", 2, size).alias("y"),
    )


def char_occurrence_labels(df: DataFrame, keys: list[str], text: str, before_only: bool = True) -> DataFrame:
    """Per text a string of digits: min(2, same characters before it | elsewhere).

    A text is moved whole and its characters are sorted inside its row, so that
    same characters are neighbours; rows of one key are labelled together.
    """
    texts = df.select(*keys, F.col(text).alias("__x")).groupBy(*keys).agg(F.collect_list("__x").alias("__x"))  # one text
    chars = F.flatten(F.transform("__x", lambda x: F.transform(F.split(x, ""), lambda c, i: F.struct(c.alias("ch"), i.alias("pos")))))
    # a generator of one element keeps the sort from being repeated for each character
    ready = texts.select(*keys, F.explode(F.array(F.sort_array(F.filter(chars, lambda s: s["ch"] != "")))).alias("__c"))
    around = (-2, -1) if before_only else (-2, -1, 1, 2)

    def label(s: Column, i: Column) -> Column:
        same = [(F.get("__c", i + k)["ch"] == s["ch"]) for k in around]
        seen = sum((F.when(F.coalesce(x, F.lit(False)), 1).otherwise(0) for x in same), F.lit(0))
        return F.struct(s["pos"].alias("pos"), F.least(F.lit(2), seen).cast("string").alias("d"))

    labelled = ready.filter(F.size("__c") > 0).select(*keys, F.sort_array(F.transform("__c", label)).alias("__l"))
    return labelled.select(*keys, F.array_join(F.transform("__l", lambda s: s["d"]), "").alias("labels"))


def build_index(df: DataFrame, value: str, order: str) -> DataFrame:
    """Dense ids from 0 in first-seen order: ``(value, id)``."""
    first = df.groupBy(value).agg(F.min(order).alias("__first"))
    ranked = rank_by_order(first, [], ["__first", value], rank="__r")
    return ranked.select(value, (F.col("__r") - 1).alias("id"))


def look_up(df: DataFrame, index: DataFrame, value: str) -> DataFrame:
    """Ids of a column's values, -1 for the unknown."""
    return df.join(index, value, "left").withColumn("id", F.coalesce("id", F.lit(-1).cast("bigint")))


def beam_topk(df: DataFrame, group: list[str], element: str, score: str, k: int) -> DataFrame:
    """The k best elements per group by their best score; ties by element."""
    best = df.groupBy(*group, element).agg(F.max(score).alias(score))
    order = Window.partitionBy(*group).orderBy(F.desc(score), element) if group else None
    if order is None:
        return best.orderBy(F.desc(score), element).limit(k)
    return best.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= k).drop("__rn")


def pending_ids(df: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Rows whose statistics are not stored yet."""
    return df.join(done.select(id_col).distinct(), id_col, "left_anti")
