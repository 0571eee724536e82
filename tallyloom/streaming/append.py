"""Appending to a table without repeating keys that are there already."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def new_rows(batch: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key of the batch that the table does not hold."""
    return batch.dropDuplicates(list(keys)).join(done.select(*keys), list(keys), "left_anti")


def append_new(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Run the available input through a merge that skips finished keys.

    Each micro-batch is written to a folder named by its number and in overwrite
    mode, so a batch that is repeated after a failure replaces itself.
    """
    schema = stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = spark.read.schema(schema).parquet(f"{path}/batch=*") if number else spark.createDataFrame([], schema)
        if number:
            from pyspark.sql import functions as F

            folder = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("bigint")
            done = done.filter(folder < number)
        new_rows(batch, done, keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_recent_duplicates(stream: DataFrame, time_col: str, delay: str, keys: Sequence[str]) -> DataFrame:
    """Streaming dedup whose state holds keys only as long as the watermark delay."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(keys))
