"""Hash values that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 32


def stable_hash(key: Column, seed: int | str = 0) -> Column:
    """First 32 bits of md5(key:seed) as BIGINT: a layout-independent order."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def stable_hash_sql(key: str, seed: int | str = 0) -> str:
    """The same value as SQL text for an engine with hex casts."""
    return f"('0x' || substr(md5(({key})::VARCHAR || ':{seed}'), 1, 8))::BIGINT"
