import os

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import text_queries as q
from tallyloom.streaming import tracks as tk

SF_DIR = "/root/testdata/sf0.001"
COLS = ["video_id", "frame", "display_id", "raw_track_id", "kind", "crossed", "reconnected", "count"]


def rows_of(df):
    return sorted(tuple(r[c] for c in COLS) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_stream_gives_the_batch_rows(spark):
    assert rows_of(q.trk_6b(spark, SF_DIR)) == rows_of(q.trk_1(spark, SF_DIR))


def moving(spark, n_rows=400, gap_after=None, gap=0):
    """Two videos of 8 boxes a frame, 4 seconds a frame; the rows of a frame are up to 15 seconds apart."""
    n = F.col("id")
    pause = F.when(n >= gap_after, gap).otherwise(0) if gap_after else F.lit(0)
    frame = F.floor(n / 8) + pause
    return spark.range(n_rows).select(
        F.concat(F.lit("v"), n % 2).alias("video_id"), frame.alias("frame"), (n % 8 + 8 * F.floor(frame / 40)).alias("raw_track_id"), F.lit("car").alias("class_name"),
        (n % 8 * 100.0 + n / 8).alias("cx"), F.floor(n / 8).cast("double").alias("cy"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"),
        F.timestamp_seconds(1_000_000 + frame * 4 + F.when(n % 8 == 7, 15).otherwise(0)).alias("ts"),
    )


def in_files(rows, folder, seconds=20):
    """One file for each span of event time, read in this order."""
    rows = rows.withColumn("part", F.floor(F.unix_seconds("ts") / seconds))
    parts = [r[0] for r in rows.select("part").distinct().orderBy("part").collect()]
    for i, part in enumerate(parts):
        rows.filter(F.col("part") == part).drop("part").coalesce(1).write.parquet(str(folder / f"p={i:04d}"))
        for name in os.listdir(folder / f"p={i:04d}"):
            os.utime(folder / f"p={i:04d}" / name, (2_000_000 + i, 2_000_000 + i))
    return len(parts)


def run_stream(spark, tmp_path, schema, rules, files="all", **more):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / files / "*"))
    tracked = tk.stream_track_reconnect(stream, rules, "ts", "30 seconds", **more)
    writer = tracked.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark"))
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(tracked.schema).parquet(str(tmp_path / "out"))


def state_rows(spark, tmp_path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "mark")).count()


@pytest.mark.parametrize("evict", [False, True])
def test_several_batches_and_a_restart(spark, tmp_path, evict):
    """The second half of the files comes after the query has ended and is started anew."""
    rules = tk.TrackRules(line=20.0, window=12, distance=120.0, evict=evict)
    rows = moving(spark, 240, gap_after=120, gap=30)
    whole = rows.unionByName(tk.closing_mark(rows, "ts", "30 seconds"))
    half = F.unix_seconds("ts") < 1_000_000 + 100
    in_files(whole.filter(half), tmp_path / "all" / "a")
    run_stream(spark, tmp_path, rows.schema, rules, "all/*")
    assert state_rows(spark, tmp_path, "waiting") > 0  # frames that the watermark has not passed
    in_files(whole.filter(~half), tmp_path / "all" / "b")
    got = run_stream(spark, tmp_path, rows.schema, rules, "all/*")
    assert rows_of(got) == rows_of(tk.track_reconnect(rows, rules))
    assert state_rows(spark, tmp_path, "waiting") == 0
    # of two videos with four boxes each; after the gap the raw numbers are others, and eviction forgets the older tracks
    assert state_rows(spark, tmp_path, "tracks") == (8 if evict else 16)


def test_idle_video_leaves_the_state_by_a_timer(spark, tmp_path):
    """Video v1 stops early; its tracks go once the watermark has passed its idle time, its numbers stay."""
    rules = tk.TrackRules(line=20.0, window=5, distance=120.0, evict=True)
    rows = moving(spark, 320).filter("video_id = 'v0' or frame < 8")
    in_files(rows, tmp_path / "all")
    got = run_stream(spark, tmp_path, rows.schema, rules, idle_ms=5 * 4 * 1000 + 15_000)
    last = got.groupBy("video_id").agg(F.max("frame").alias("f")).collect()
    assert {r.video_id for r in last} == {"v0", "v1"} and dict(map(tuple, last))["v1"] == 7
    keys = spark.read.format("statestore").option("stateVarName", "tracks").load(str(tmp_path / "mark")).select("key.video_id").distinct().collect()
    assert [r[0] for r in keys] == ["v0"]
    assert state_rows(spark, tmp_path, "totals") == 2
    batch = tk.track_reconnect(rows, rules)
    ends = {v: f for v, f in map(tuple, last)}
    assert rows_of(got) == [r for r in rows_of(batch) if r[1] <= ends[r[0]]]
