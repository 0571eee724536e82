"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing column names."""

from __future__ import annotations

import random
import re

CLASHES = ["size", "row", "key", "node", "text_hash", "score", "n", "hit", "spans", "component", "label", "target", "rank", "v", "id"]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed: int, n: int, size: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def edited(text: str, at: list[int], by: str = "edit") -> str:
    parts = text.split(" ")
    for i in at:
        parts[i] = f"{by}{i}"
    return " ".join(parts)


def documents() -> list[tuple[int | None, str | None, str | None]]:
    """``(doc_id, text, source)``."""
    base, passage = prose(1, 300), prose(2, 60)
    rows = [
        (1, base, "a"),
        (2, edited(base, [100]), "a"),
        (3, edited(base, [10, 200]), "b"),
        (4, edited(edited(base, [100]), [250, 280], "other"), "b"),
        (5, prose(3, 120) + " " + passage + " " + prose(4, 90), "a"),
        (6, passage + " " + prose(5, 40), "c"),
        (7, passage, None),
        (8, None, "a"),
        (9, "", "a"),
        (10, " \t\n\x0b ", "b"),
        (11, "one", "b"),
        (12, "ONE", "c"),
        (13, "two words", "c"),
        (14, "two  words\n", ""),
        (15, "é ü ß 日本語 🙂 x", "ä"),
        (16, "x" * 5000, "z"),
        (17, "A A A A " * 200, "z"),
        (18, prose(6, 30_000), "long"),
        (18, prose(6, 30_000), "long"),  # an equal row
        (19, prose(7, 50), "b"),
        (19, prose(8, 50), "b"),  # the same id, another text
        (None, prose(9, 80), "a"),
        (None, None, None),
        (-5, "Minus five " + prose(10, 30), "a"),
    ]
    letters = [bin(i).count("1") % 2 for i in range(1024)]  # equal polynomial hashes modulo 2**64, whatever the base
    rows += [(90 + i, "".join("ab"[x ^ i] for x in letters), "letters") for i in range(2)]
    small = prose(11, 14, 10**6).split(" ")
    rows += [(30 + i, " ".join(small[: 14 - i]), "s") for i in range(5)]  # small sets one shingle apart
    rows += [(40 + i, edited(base, [50 + i]), "group") for i in range(25)]  # a group of near copies
    rows += [(70 + i, prose(100 + i, 25) + " " + " ".join(["common line of text that all of these documents share"] * 6), "boiler") for i in range(25)]
    return rows


SCHEMA = "doc_id long, text string, source string"


def frame(spark, rows=None):
    """The documents with a ``lang``, ``n_chars`` and columns whose names clash with ones used inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("bigint").alias("n_chars"), *[F.lit(c).alias(c) for c in CLASHES])


def key(row) -> tuple:
    return tuple((x is None, str(x)) for x in row)
