"""Corpora: one sentence per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import SPECIALS, tokens_of


def _checked(lines: DataFrame, keep: list[str], strict: bool) -> DataFrame:
    tokens = tokens_of(F.col("line"), drop=() if strict else SPECIALS)
    if strict:
        special = F.exists(tokens, lambda t: t.isin(*SPECIALS))
        tokens = F.when(special, F.raise_error(F.lit("special word in corpus text"))).otherwise(tokens)
    return lines.select(*keep, tokens.alias("tokens"))


def read_corpus(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Text files (gz and bz2 by extension) to ``(file, tokens)``; blank lines stay.

    A line ends at a line feed alone; a carriage return is white space.  Null
    characters are, too.  ``strict`` makes a special word an error.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return _checked(lines, ["file"], strict)


def sentences(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", strict: bool = False) -> DataFrame:
    """A text column to ``(id, line_no, tokens)``, one row per line."""
    lines = documents.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return _checked(lines, [id_col, "line_no"], strict)
