"""CSV, JSON and binary readers and writers for evaluation tables and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.replies import response_text, strip
from ..functions.stable import stable_hash
from .order import file_order, path_below

PAIR_COLUMNS = ["id", "sent0", "sent1", "gold"]
PAIR_SCHEMA = "id string, sent0 string, sent1 string, gold int"
PREDICTION_SCHEMA = "id string, method string, pred int, gold int, correct int, notes string"
CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs; a header other than id, sent0, sent1, gold is an error."""
    header = spark.read.options(**CSV).csv(path).columns
    if header != PAIR_COLUMNS:
        raise ValueError(f"unexpected header {header}")
    return spark.read.options(**CSV).schema(PAIR_SCHEMA).csv(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(*PAIR_COLUMNS).write.options(header="true", quote='"', escape='"').csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction rows with ``row_order`` following file and line order."""
    return spark.read.options(**CSV).schema(PREDICTION_SCHEMA).csv(path).withColumn("row_order", file_order())


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.select("id", "method", "pred", "gold", "correct", "notes").write.options(header="true", quote='"', escape='"').csv(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of replies; the text is the first non-empty of response, output_text, text."""
    schema = "id string, method string, sample_index int, gold int, sent0 string, sent1 string, candidate_id string, response string, output_text string, text string"
    rows = spark.read.schema(schema).json(path)
    value = response_text(F.col("response"), F.col("output_text"), F.col("text"))
    missing = F.raise_error(F.concat(F.lit("no reply text for "), F.coalesce("id", F.lit("?")))).cast("string")
    return rows.select(
        "id", "method", "sample_index", "gold", "sent0", "sent1", "candidate_id", F.coalesce(value, missing).alias("text"),
        file_order().alias("row_order"),
    )


def read_questions(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Questions from JSON lines or one JSON list; falls back to the second message after 'User:'."""
    schema = "question string, answer string, messages array<struct<role string, content string>>"
    rows = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    second = F.get("messages", F.lit(1))["content"]
    after = F.when(second.contains("User:"), F.element_at(F.split(second, "User:"), 2)).otherwise(second)
    q = strip(F.coalesce(F.nullif(strip(F.col("question")), F.lit("")), after))
    return rows.select(q.alias("question"), "answer").filter("question <> ''")


def read_episodes(spark: SparkSession, root: str, splits: Sequence[str], columns: Sequence[str], max_episodes: int | None = None, seed: int = 0) -> DataFrame:
    """Frames of the splits' Parquet files; per split a hashed sample of files."""
    out = None
    for split in splits:
        rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{split}")
        if max_episodes is not None:
            files = rows.inputFiles()  # file names only
            names = spark.createDataFrame([(f,) for f in files], "path string")
            chosen = [r[0] for r in names.orderBy(stable_hash(F.regexp_extract("path", r"([^/]*)$", 1), seed), "path").limit(max_episodes).collect()]
            rows = spark.read.parquet(*chosen) if chosen else rows.limit(0)
        rows = rows.select(F.lit(split).alias("split"), *columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def to_columnar(spark: SparkSession, path: str, out: str, schema: str, partition_by: str | None = None) -> DataFrame:
    """JSON lines to zstd Parquet; returns the lines that could not be parsed."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    writer = rows.filter("_corrupt_record is null").drop("_corrupt_record").write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(out)
    # a file scan may not ask for the corrupt column alone
    return rows.filter("_corrupt_record is not null").select("_corrupt_record", F.lit("json").alias("reason"))


def read_metric_files(spark: SparkSession, path: str) -> DataFrame:
    """All metric CSVs of a folder with their file name."""
    rows = spark.read.option("header", "true").schema("method string, metric string, value double, split string, notes string").csv(path)
    return rows.select("*", F.col("_metadata.file_name").alias("source"), file_order().alias("row_order"))


def artifact_manifest(spark: SparkSession, path: str, expected: Column) -> DataFrame:
    """Lines per file against the expected number (null: any); ``expected`` reads ``file``, the path below the folder."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    counted = lines.groupBy(path_below(spark, path, F.col("_metadata.file_path")).alias("file")).agg(F.count(F.lit(1)).alias("lines"))
    checked = counted.withColumn("expected_lines", expected.cast("bigint"))
    ok = F.col("expected_lines").isNull() | (F.col("lines") == F.col("expected_lines"))
    return checked.withColumn("status", F.when(ok, "ok").otherwise("check"))


def file_integrity(spark: SparkSession, path: str, manifest: DataFrame, hashes: bool = True) -> DataFrame:
    """Manifest ``(file, sha256, min_size)`` against the files by their path below the folder; content is only read for hashes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = path_below(spark, path, F.col("path"))
    found = files.select(name.alias("file"), F.col("length").alias("size"), *([F.sha2("content", 256).alias("actual")] if hashes else []))
    same = (F.col("sha256").isNull() | (F.col("actual") == F.col("sha256"))) if hashes else F.lit(True)
    status = (
        F.when(F.col("size").isNull(), "missing").when(F.col("size") < F.col("min_size"), "too small").when(~same, "hash mismatch").otherwise("ok")
    )
    return manifest.join(found, "file", "left").select("file", "size", status.alias("status"))
