"""Triple files: comma lines of five or seven columns, JSON lines with key variants, whole books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.book_rules import DEFAULT_CATEGORY, DEFAULT_TYPE, QUESTION_WORDS
from ..functions.names import lookup
from ..functions.replies import strip
from ..operators.graph_clean import csv_safe
from .order import file_order

# fixed values: the names each field may have in JSON, in order of preference
JSON_KEYS = {
    "head": ("head", "h", "subject", "s"),
    "tail": ("tail", "t", "object", "o"),
    "relation": ("relation", "rel", "predicate", "p"),
    "head_cate": ("head_cate", "h_cate", "cate_h", "hCate"),
    "tail_cate": ("tail_cate", "t_cate", "cate_t", "tCate"),
    "head_type": ("head_type", "h_type", "type_h", "hType"),
    "tail_type": ("tail_type", "t_type", "type_t", "tType"),
}
DEFAULTS = {"head_cate": DEFAULT_CATEGORY, "tail_cate": DEFAULT_CATEGORY, "head_type": DEFAULT_TYPE, "tail_type": DEFAULT_TYPE}


def _filled(value: Column, name: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(DEFAULTS[name])) if name in DEFAULTS else value


def read_triples(spark: SparkSession, path: str, synonyms: dict = QUESTION_WORDS) -> DataFrame:
    """Comma lines; comments, blank and short lines and lines without head, tail or relation are skipped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("value"), file_order().alias("line_no"))
    parts = F.transform(F.split("value", ","), strip)
    rows = lines.filter((F.col("value") != "") & ~F.col("value").startswith("#")).select("line_no", parts.alias("p")).filter(F.size("p") >= 5)
    order = ("head", "tail", "relation", "head_cate", "tail_cate", "head_type", "tail_type")
    named = rows.select("line_no", *[_filled(F.get("p", F.lit(i)), n).alias(n) for i, n in enumerate(order)])
    return named.filter("head <> '' and tail <> '' and relation <> ''").withColumn("relation", lookup(synonyms, F.col("relation")))


def read_triples_json(spark: SparkSession, path: str, synonyms: dict = QUESTION_WORDS) -> DataFrame:
    """JSON lines with one object or a list of objects each; other lines are skipped."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("value"), file_order().alias("line_no"))
    one = F.array(F.from_json("value", "map<string,string>"))
    many = F.from_json("value", "array<map<string,string>>")
    maps = lines.select("line_no", F.explode(F.when(F.col("value").startswith("["), many).otherwise(one)).alias("m")).filter("m is not null")
    first = lambda keys: F.coalesce(*[F.nullif(strip(F.col("m")[k]), F.lit("")) for k in keys], F.lit(""))
    named = maps.select("line_no", *[_filled(first(keys), n).alias(n) for n, keys in JSON_KEYS.items()])
    return named.filter("head <> '' and tail <> '' and relation <> ''").withColumn("relation", lookup(synonyms, F.col("relation")))


def triple_lines(edges: DataFrame, mode: str = "mixed") -> DataFrame:
    """``line``: five columns (v1), seven (v2), or five between persons and seven otherwise (mixed)."""
    five = F.concat_ws(",", *[csv_safe(F.col(c)) for c in ("head", "tail", "relation", "head_cate", "tail_cate")])
    seven = F.concat_ws(",", five, csv_safe(F.col("head_type")), csv_safe(F.col("tail_type")))
    persons = (F.col("head_type") == DEFAULT_TYPE) & (F.col("tail_type") == DEFAULT_TYPE)
    line = {"v1": five, "v2": seven, "mixed": F.when(persons, five).otherwise(seven)}[mode]
    return edges.withColumn("line", line)


def write_triples(edges: DataFrame, path: str, mode: str = "mixed") -> None:
    triple_lines(edges, mode).select("line").write.text(path)


#: Ends a book of a file that holds several.
BOOK_END = "\u0001"


def write_books(books: DataFrame, path: str, id_col: str, text: str) -> None:
    """Books as records ``id <line feed> text`` of a few files; rows of one id are one book.

    A file per book costs the driver and the file system a folder entry each,
    whatever the book's length.  The record's end mark is dropped from the texts.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct(text))), lambda s: F.coalesce(s[text], F.lit("")))  # one book
    whole = books.groupBy(id_col).agg(F.array_join(parts, "").alias("__t"))
    body = F.translate("__t", BOOK_END, "")
    record = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\n"), body)
    whole.select(record.alias("value")).write.option("lineSep", BOOK_END).text(path)


def read_books(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """One row per file with its whole text, or with ``end`` one row per record of files of many books."""
    files = spark.read.text(path, wholetext=True) if end is None else spark.read.option("lineSep", end).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
