"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes and, but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, mixing, quality, repeats, setjoin
from tallyloom.llm.registry import table
from tallyloom.session import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voters of the labelled ones do not reject."""
    voters = quality.fit_voters(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "doc_id", "quality")
    scored = quality.with_score(docs, "text", docs.columns, voters)
    return scored.filter(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by Jaccard similarity of five-word shingles."""
    return setjoin.one_of_each(docs, "doc_id", "text", k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that occur elsewhere too; a document may be left empty."""
    cut = repeats.without_repeats(docs, "doc_id", "text", [c for c in docs.columns if c != "text"], as_text=True)
    changed = {"text": F.col("__kept"), "n_chars": F.length("__kept").cast("bigint")}
    return cut.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, "text", docs.columns, table(spark, sf_dir, "benchmark"), "item_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its words, its source's words and target, and the words that the mix takes of it."""
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "row_id")]
    rows, takes = mixing.mix(docs, F.col("text"), F.col("source"), F.col("doc_id"), own)
    return mixing.taken(rows, takes)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("leaks", drop_leaks),
    ("mix", mix_sources),
]

#: Voting and suffix sorting are not SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
