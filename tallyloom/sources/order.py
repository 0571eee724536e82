"""The order of rows in files, and file names below a folder."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def file_order() -> Column:
    """A struct that sorts rows by file, then by line: one task reads a block of a file in order."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def path_below(spark: SparkSession, root: str, path: Column) -> Column:
    """The part of a file's path below the folder ``root``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().toString()
    return F.substr(_plain(path), F.length(_plain(F.lit(whole.rstrip("/")))) + 2)
