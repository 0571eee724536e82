"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hash joins where every post-shuffle partition is known to be small, sort-merge otherwise
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and benches; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode, where driver and executors
    share one disk; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="tallyloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder; an open ``scratch`` removes it at its end."""
    path = os.path.join(checkpoint_root(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    if _open:
        _open[-1].append(path)
    return path


def _write(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str], mode: str) -> None:
    """Write as Parquet; sorted rows are stored as what each adds to the one before.  The write's shuffle files go with it."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        if sort:
            df = df.sortWithinPartitions(*by, *sort)
        writer = df.write.mode(mode).option("compression", "zstd" if sort else "lz4").partitionBy(*by)
        if sort:
            writer = writer.option("parquet.writer.version", "PARQUET_2_0")
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, by: Sequence[str] = (), sort: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, a folder for each value of ``by``, and read it back.

    Cuts the lineage in a way that outlives any executor, keeps column pruning
    and filter push-down for later readers, and gives the optimizer real sizes.
    The write's shuffle files are removed with it.  With ``sort`` the rows of a
    task are sorted by these columns and take less room on disk.
    """
    path = new_path(df.sparkSession, name)
    _write(df, path, by, sort, "errorifexists")
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


class Growing:
    """A table written part by part: ``order`` names a folder of parts, ``slice`` one of rows below it.

    Each part is a job whose shuffle files go before the next one begins, so that the disk holds
    the table and one part's shuffle.  Its folder belongs to the scope in which it is made.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.columns, self.schema = spark, new_path(spark, name), [], ""

    def add(self, order: int, rows: DataFrame, sort: str = "words") -> None:
        """Rows with a column ``slice``; every part has the same columns."""
        if not self.columns:
            kinds = [(n, t) for n, t in rows.dtypes if n != "slice"]
            self.columns = ["order", *[n for n, _ in kinds], "slice"]
            self.schema = ", ".join(["order int", *[f"`{n}` {t}" for n, t in kinds], "slice int"])
        _write(rows.select(*self.columns[1:]), f"{self.path}/order={order}", ["slice"], [sort], "append")

    def drop(self, order: int) -> None:
        remove(self.spark, f"{self.path}/order={order}")

    def read(self, order: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path).select(self.columns)
        return rows if order is None else rows.filter(rows["order"] == order)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a written folder, wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def move_files(spark: SparkSession, path: str, to: str, prefix: str) -> None:
    """Move the parts of a written folder into another one, their names behind ``prefix``."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    fs = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(paths(to))
    for found in fs.listStatus(paths(path)):
        name = found.getPath().getName()
        if name.startswith("part-"):
            if not fs.rename(found.getPath(), paths(to, f"part-{prefix}-{name[len('part-'):]}")):
                raise OSError(f"cannot move {name} from {path} to {to}")
    remove(spark, path)


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are removed at the end, but for those that the given function writes.

    What leaves the block must be written by that function or be rows on the
    driver; a scope around this one removes its tables in turn.
    """
    own: list[str] = []
    _open.append(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        level = _open.pop()
        try:
            return materialise(df, name)
        finally:
            _open.append(level)

    try:
        yield keep
    finally:
        _open.remove(own)
        for path in own:
            remove(spark, path)
