"""Readers keep file and line order; file operators tell files of one base name apart."""

import math

from pyspark.sql import functions as F

from tallyloom.functions.quantiles import exact_quantiles
from tallyloom.operators import documents as dc
from tallyloom.operators import evaluation as ev
from tallyloom.operators import statistics as st
from tallyloom.sources import tables, triples


def test_the_larger_file_last_by_name(spark, tmp_path):
    head = "id,method,pred,gold,correct,notes\n"
    (tmp_path / "a.csv").write_text(head + "1,m,0,0,1,x\n")
    (tmp_path / "b.csv").write_text(head + "".join(f"{i},m,1,0,0,{'y' * 50}\n" for i in range(1, 400)))
    rows = tables.read_predictions(spark, str(tmp_path)).orderBy("row_order").collect()
    assert [r.id for r in rows] == ["1", *[str(i) for i in range(1, 400)]]
    vote = ev.uncertainty(tables.read_predictions(spark, str(tmp_path))).filter("id = '1'").first()
    assert vote.pred == 0  # a tie, seen first in a.csv


def test_triples_and_metrics_in_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,友,c,d\n")
    (tmp_path / "b.csv").write_text("".join(f"h{i},t{i},友,c,d\n" for i in range(300)))
    got = triples.read_triples(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.head for r in got] == ["x", *[f"h{i}" for i in range(300)]]


def test_files_of_one_base_name(spark, tmp_path):
    for folder, lines in (("u", 2), ("v", 3)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "f.txt").write_text("line\n" * lines)
    got = tables.artifact_manifest(spark, str(tmp_path), F.lit(2)).orderBy("file").collect()
    assert [tuple(r) for r in got] == [("u/f.txt", 2, 2, "ok"), ("v/f.txt", 3, 2, "check")]
    manifest = spark.createDataFrame([("u/f.txt", None, 1), ("v/f.txt", None, 99), ("w/f.txt", None, 1)], "file string, sha256 string, min_size long")
    got = tables.file_integrity(spark, str(tmp_path), manifest, hashes=False).orderBy("file").collect()
    assert [r.status for r in got] == ["ok", "too small", "missing"]


def test_types_of_all_rows(spark):
    rows = spark.range(500).select(F.when(F.col("id") == 499, "late").otherwise(F.col("id").cast("string")).alias("c"))
    assert [tuple(r) for r in dc.infer_types(rows, ["c"]).collect()] == [("c", "string")]


def test_quantiles_of_wide_and_narrow_spans(spark):
    values = [-1e308, 1e308, 0.0, math.inf, -math.inf, math.nan, None]
    got = exact_quantiles(spark.createDataFrame([(v,) for v in values], "x double"), {"x": F.col("x")}, [0.0, 0.5, 1.0])
    assert got["x"] == [-1e308, 0.0, 1e308]
    tiny = exact_quantiles(spark.createDataFrame([(0.0,), (5e-324,), (5e-324,)], "x double"), {"x": F.col("x")}, [0.0, 0.5])
    assert tiny["x"] == [0.0, 5e-324]


def test_zero_weight_and_bare_methods(spark):
    a = spark.createDataFrame([(1, 2.0, "0.0", "3"), (2, 2.0, "", "3"), (3, 2.0, None, None)], "k int, v double, w1 string, w2 string")
    got = st.paired_join(a, a.select("k", "v"), "k", "v", ["w1", "w2"]).orderBy("k").collect()
    assert [r.weight for r in got] == [0.0, 3.0, 1.0]
    p = spark.createDataFrame([("1", "a:x", 0), ("1", "a:y", 0), ("1", "plain", 1), ("2", "plain", 1), ("2", "plain", 0)], "id string, method string, pred int")
    assert [tuple(r) for r in ev.prompt_consistency(p).collect()] == [("a", 1.0, 1)]
