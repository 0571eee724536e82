"""ARPA model files and plain count files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, move_files

#: Entries that are sorted at a time.
SORT_ROWS = 4_000_000
#: Words drawn of an order, to cut it into ranges of like size; what is drawn changes no line.
DRAWN = 10_000


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_root(spark), "files", f"{uuid.uuid4().hex}-{name}")


def write_arpa(lm: DataFrame, path: str, order: int, compression: str = "none") -> None:
    """Text parts whose concatenation in name order is one ARPA file, of gzip members with that ``compression``.

    Rows are range-partitioned by (order, kind, words); the section titles and
    the count header are rows of the same sort, so no single task sees the model.
    An entry goes there as its words and numbers and becomes a line behind the sort.
    A large order is sorted range by range, so that the disk holds one range's shuffle.
    """
    spark = lm.sparkSession
    sizes = {r["order"]: r["n"] for r in lm.groupBy("order").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per order
    counts = spark.createDataFrame(list(sizes.items()), "order int, n bigint")
    number = F.col("order").cast("string")
    none = F.lit(None)
    entries = lm.select(F.col("order").alias("o"), F.lit(1).alias("kind"), F.col("words").alias("key"), none.cast("string").alias("title"), "prob", "backoff")
    numbers = [none.cast("double").alias("prob"), none.cast("double").alias("backoff")]
    titles = counts.select(
        F.col("order").alias("o"), F.lit(0).alias("kind"), F.lit("").alias("key"), F.concat(F.lit("\n\\"), number, F.lit("-grams:")).alias("title"), *numbers
    )
    heads = counts.select(
        F.lit(0).alias("o"), F.lit(1).alias("kind"), F.lpad(number, 10, "0").alias("key"), F.concat(F.lit("ngram "), number, F.lit("="), F.col("n")).alias("title"), *numbers
    )
    ends = spark.createDataFrame(
        [(0, 0, "", "\\data\\"), (order + 1, 0, "", "\n\\end\\")], "o int, kind int, key string, title string"
    ).select("*", *numbers)
    rows = entries.unionByName(titles).unionByName(heads).unionByName(ends)
    sort = ["o", "kind", "key"]
    body = F.concat_ws("\t", F.col("prob").cast("string"), "key", F.when(F.col("o") < order, F.col("backoff").cast("string")))
    write = lambda some, to: some.repartitionByRange(*sort).sortWithinPartitions(*sort).select(
        F.coalesce("title", body).alias("value")
    ).write.option("compression", compression).text(to)
    if sum(sizes.values()) <= SORT_ROWS:
        write(rows, path)
        return
    ranges = [F.col("o") == 0]
    for k in sorted(sizes):
        ranges += [(F.col("o") == k) & r for r in _ranges(lm.filter(F.col("order") == k), sizes[k])]
    ranges.append(F.col("o") > max(sizes))
    for i, r in enumerate(ranges):
        write(rows.filter(r), f"{path}.{i}")
        move_files(spark, f"{path}.{i}", path, f"{i:05d}")


def _ranges(rows: DataFrame, n: int) -> list[Column]:
    """Conditions on ``key`` that cut the n-grams into ranges in order; titles, whose key is '', are in the first."""
    want = -(-n // SORT_ROWS)
    if want == 1:
        return [F.lit(True)]
    drawn = sorted((r["words"] for r in rows.select("words").sample(min(1.0, DRAWN / n), seed=0).collect()), key=lambda w: w.encode())
    cuts = sorted({drawn[len(drawn) * i // want] for i in range(1, want)}, key=lambda w: w.encode()) if drawn else []
    least, most = [None, *cuts], [*cuts, None]
    key = F.col("key")
    return [(F.lit(True) if a is None else key >= a) & (F.lit(True) if b is None else key < b) for a, b in zip(least, most, strict=True)]


def read_arpa(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """``(order, words, prob, backoff)``; the order is the number of words.

    The check compares the count header with the entries and rejects values that
    are no finite number and a backoff on the highest order.
    """
    lines = spark.read.text(path).filter((F.col("value") != "") & ~F.col("value").startswith("#"))
    cols = F.split("value", "\t")
    entries = lines.filter(F.size(cols) >= 2).select(
        F.size(F.split(cols[1], " ")).alias("order"),
        cols[1].alias("words"),
        F.expr("try_cast(split(value, '\t')[0] as double)").alias("prob"),
        F.when(F.size(cols) > 2, F.expr("try_cast(split(value, '\t')[2] as double)")).otherwise(0.0).alias("backoff"),
        (F.size(cols) > 2).alias("__has"),
    )
    if check:
        header = lines.filter(F.col("value").startswith("ngram ")).select(
            F.regexp_extract("value", r"^ngram (\d+)=\s*\d+", 1).cast("int").alias("order"),
            F.regexp_extract("value", r"^ngram \d+=\s*(\d+)", 1).cast("bigint").alias("n"),
        )
        said = {r["order"]: r["n"] for r in header.collect()}  # one row per order
        finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
        top = max(said, default=0)
        seen = {
            r["order"]: r
            for r in entries.groupBy("order").agg(
                F.count(F.lit(1)).alias("n"),
                F.count_if(~(finite("prob") & finite("backoff"))).alias("bad"),
                F.count_if(F.col("__has") & (F.col("backoff") != 0)).alias("bows"),
            ).collect()
        }
        if {k: r["n"] for k, r in seen.items()} != {k: v for k, v in said.items() if v}:
            raise ValueError(f"count header {said} does not match the entries")
        if any(r["bad"] for r in seen.values()):
            raise ValueError("a probability or backoff is not a finite number")
        if top in seen and seen[top]["bows"]:
            raise ValueError("backoff on the highest order")
    return entries.drop("__has")


def write_counts(counts: DataFrame, path: str) -> None:
    counts.select(F.concat_ws("\t", "words", F.col("raw").cast("string")).alias("value")).write.text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``words <tab> anything`` lines to ``(words, rest)``."""
    at = F.instr("value", "\t")
    return spark.read.text(path).select(
        F.substr("value", F.lit(1), at - 1).alias("words"), F.substr("value", at + 1).alias("rest")
    )
