import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import classification as cv
from tallyloom.operators import documents as dc
from tallyloom.operators import graph as kg
from tallyloom.operators import graph_clean as gc
from tallyloom.operators import points as pt
from tallyloom.operators import statistics as st
from tallyloom.sources import tables as tb
from tallyloom.streaming import tracks as tk

EDGE = "line_no bigint, head string, tail string, relation string, head_cate string, tail_cate string, head_type string, tail_type string"


def edges(spark, rows):
    return spark.createDataFrame([(i, h, t, r, hc, "其他", "Person", "Person") for i, (h, t, r, hc) in enumerate(rows)], EDGE)


def test_self_loop_appears_twice_and_modes(spark):
    e = edges(spark, [("a", "a", "r", "其他"), ("X", "y", "r", "其他"), ("X", "y", "q", "其他"), ("X", "z", "r", "c"), ("X", "z", "s", "c"), ("X", "w", "s", "c")])
    assert kg.neighbors(e, "a").count() == 2
    modes = {r["name"]: r["cate_mode"] for r in gc.entity_modes(e).collect()}
    assert modes["X"] == "c" and modes["a"] == "其他"


def test_longest_subject(spark):
    q = spark.createDataFrame([(1, "贾宝玉的父亲是谁"), (2, "nobody")], "qid int, question string")
    n = spark.createDataFrame([("宝玉",), ("贾宝玉",)], "name string")
    assert [tuple(r) for r in kg.link_subject(q, n).collect()] == [(1, "贾宝玉")]
    words = [(r["hop"], r["word"]) for r in kg.extract_relations(q).collect()]
    assert words == [(1, "父亲")]


def test_written_numbers(spark):
    df = spark.createDataFrame([("十",), ("二十三",), ("一百二十",), ("千零一",), ("007",), ("x",), ("零",)], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", gc.written_number(F.col("t")).alias("n")).collect()}
    assert got == {"十": 10, "二十三": 23, "一百二十": 120, "千零一": 1001, "007": 7, "x": None, "零": None}


def test_chunks_greedy_and_compatible():
    body = "\n\n".join(["a" * 100] * 6)
    greedy = gc.chunk_chapter(body, 200, 0, False)
    assert [len(c) for c in greedy] == [302, 302]
    compat = gc.chunk_chapter(body, 200, 0, True)
    assert sum(c.count("a") for c in compat) == 600
    assert len(compat) > len(greedy)
    assert len(compat[0]) == len(greedy[0]) and all(len(c) == 100 for c in compat[1:])
    lapped = gc.chunk_chapter("\n\n".join(["a" * 100] * 5), 200, 20, False)
    assert lapped[1].startswith("a" * 20 + "\n") and len(lapped[1]) == 222
    assert len(gc.chunk_chapter(body, 200, 20, False)[1]) == 181  # over the cap: trimmed at the front
    long = "x" * 130 + "。" + "y" * 100
    assert gc.chunk_chapter(long, 200, 0, False)[0].split("\n") == ["x" * 130 + "。", "y" * 100]


def test_evidence():
    text = "甲来了。乙在山上遇见丙，又遇见丁。后来乙走了，丙也走了"
    assert gc.shortest_evidence(text, "乙", "丙") == "后来乙走了，丙也走了"
    assert gc.shortest_evidence(text, "乙", "戊") is None


def test_salvage(spark):
    cut = '[{"a": "}"}, {"b": {"c": 1}}, {"d": '
    assert json.loads(gc.salvage(cut)) == [{"a": "}"}, {"b": {"c": 1}}]
    assert json.loads(gc.salvage('x "relations": [{"a": 1}, {"b')) == [{"a": 1}]
    assert gc.salvage("nothing") is None


def test_decisions(spark):
    c = spark.createDataFrame([(i,) for i in range(4)], "id int")
    d = spark.createDataFrame([(0, True, "", 0), (1, False, "no", 0), (2, None, "?", 0)], "id int, keep boolean, reason string, row_order int")
    kept, log = gc.apply_decisions(c, d)
    assert {r["id"] for r in kept.collect()} == {0, 3} and {r["id"]: r["reason"] for r in log.collect()} == {1: "no", 2: "?"}


def test_html():
    page = "<html><head><title>T &amp; t</title><style>p{}</style></head><body><div>a<p>b<p>c</div><div> </div><script>x</script><!-- z --><p>d<br>e</body>"
    assert dc.html_blocks(page) == ("T & t", ["abc", "b", "c", "de"])
    assert dc.html_blocks(page, leaf_only=True)[1] == ["b", "c", "de"]


def test_file_types(spark):
    df = spark.createDataFrame([("https://github.com/",), ("https://x.org/a%20b.PDF?q=1",), ("/d/e.png",), ("/d/note",), ("C:\\a\\b.csv",)], "p string")
    got = [tuple(r) for r in df.select(dc.url_basename(F.col("p")), dc.file_type(F.col("p"), F.lit("<p>"))).collect()]
    assert got == [("github.com", "html"), ("a b.PDF", "pdf"), ("e.png", "image"), ("note", "html"), ("b.csv", "csv")]


def test_confusion_and_loss(spark):
    rows = spark.createDataFrame(list(zip([0, 0, 1, 2, 2], [0, 1, 1, 2, 0])), "t int, p int")
    dense = cv.dense_confusion(cv.confusion_matrix(rows, "t", "p", 3), 3).orderBy("truth", "pred").collect()
    assert [r["n"] for r in dense] == [1, 1, 0, 0, 1, 0, 1, 0, 1]
    loss = spark.createDataFrame([(1.0, 2), (3.0, 1)], "l double, n int")
    assert cv.weighted_loss(loss, "l", "n").first()[0] == pytest.approx(5 / 3)


def test_small_class_split(spark):
    rows = spark.range(3).withColumn("label", F.lit("a"))
    got = sorted(r["split"] for r in cv.stratified_split(rows, "id", "label", 0.5, 0.5, 0).collect())
    assert got == ["test", "train", "val"]


def test_chunks_of_actions(spark):
    rows = spark.createDataFrame([(1, i, [float(i)]) for i in range(3)], "ep int, f int, a array<double>")
    got = {r["f"]: (r["chunk"], r["valid"]) for r in cv.action_chunks(rows, "ep", "f", "a", 2).collect()}
    assert got == {0: ([[0.0], [1.0]], [True, True]), 1: ([[1.0], [2.0]], [True, True]), 2: ([[2.0], [0.0]], [True, False])}


def test_pca_and_effects(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 2
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    _, loads, var = st.pca(df, "v", 2)
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(x))
    assert var == pytest.approx(values[::-1][:2], rel=1e-6)
    assert np.abs(loads.T @ vectors[:, ::-1][:, :2]) == pytest.approx(np.eye(2), abs=1e-6)
    a, u = rng.integers(0, 2, 400), rng.normal(size=400)
    m = 1.0 + 2.0 * a + 0.5 * u + rng.normal(size=400)
    y = 3.0 + 1.0 * a + 0.7 * m + 0.2 * a * m - u
    rows = spark.createDataFrame([(float(p), float(q), float(r), float(s)) for p, q, r, s in zip(a, m, y, u)], "a double, m double, y double, u double")
    e = st.natural_effects(rows, "y", "a", "m", ["u"])
    theta = np.linalg.lstsq(np.column_stack([np.ones(400), a, u]), m, rcond=None)[0]
    assert e["nde"] == pytest.approx((1.0 + 0.2 * (theta[0] + theta[2] * u)).mean(), abs=1e-6)
    assert e["nie"] == pytest.approx(0.9 * theta[1], abs=1e-6)
    assert st.p_value(1.959963984540054) == pytest.approx(0.05)


def test_point_filter_keeps_object(spark):
    rng = np.random.default_rng(7)
    obj, logo, far = rng.normal(0, 0.05, (600, 3)), rng.normal(0, 0.03, (180, 3)), rng.normal(0, 1.5, (300, 3)) + 4
    rows = [(*p, 0.1, 0.6, 0.1) for p in obj] + [(*p, 0.9, 0.9, 0.9) for p in logo] + [(*p, 0.5, 0.5, 0.6) for p in far]
    df = spark.createDataFrame([(i, *[float(v) for v in r], 0.9) for i, r in enumerate(rows)], "id bigint, x double, y double, z double, r double, g double, b double, opacity double")
    kept, report = pt.color_anchor_filter(df, min_keep=100, distance_ratio=0.01)
    assert report["applied"]
    ids = {r["id"] for r in kept.filter("keep").collect()}
    assert len([i for i in ids if i < 600]) > 0.95 * 600 and len([i for i in ids if 600 <= i < 780]) > 0.95 * 180 and len([i for i in ids if i >= 780]) < 15
    assert pt.spatial_core_filter(df)[1]["reason"] == "too_few_core_points"


def detections(spark, rows):
    return spark.createDataFrame([("v", f, r, c, float(x), float(y), float(w), float(h)) for f, r, c, x, y, w, h in rows], ", ".join(
        f"{n} {t}" for n, t in zip(tk.COLUMNS, ["string", "bigint", "bigint", "string", "double", "double", "double", "double"])))


def test_reconnect_and_predict(spark):
    rows = [(1, 10, "car", 500, 420, 120, 70), (11, 10, "car", 560, 420, 120, 70), (31, 77, "taxi", 680, 420, 118, 72)]
    got = tk.track_reconnect(detections(spark, rows), tk.TrackRules(640.0)).collect()
    last = [r for r in got if r["frame"] == 31][0]
    assert last["display_id"] == 1 and last["reconnected"] and last["crossed"] and last["count"] == 1
    assert not [r for r in got if r["kind"] == "predicted"]
    far = [(1, 10, "car", 500, 420, 120, 70), (20, 88, "car", 1050, 420, 120, 70)]
    assert {r["display_id"] for r in tk.track_reconnect(detections(spark, far), tk.TrackRules(640.0, distance=120.0)).collect()} == {1, 2}
    lost = [(1, 5, "car", 500, 0, 9, 9), (11, 5, "car", 600, 0, 9, 9), (16, 6, "dog", 0, 0, 9, 9)]
    hit = [r for r in tk.track_reconnect(detections(spark, lost), tk.TrackRules(640.0)).collect() if r["kind"] == "predicted"]
    assert [(r["frame"], r["display_id"], r["count"]) for r in hit] == [(16, 1, 1)]


def test_segments_equal_one_run(spark):
    rng = np.random.default_rng(3)
    rows, f = [], 0
    for _ in range(60):
        f += int(rng.choice([1, 2, 30, 200]))
        rows += [(f, int(k), "car", *rng.uniform(0, 900, 2), 50, 50) for k in rng.choice(9, 2, replace=False)]
    rules = tk.TrackRules(450.0, evict=True)
    got = sorted((r["frame"], r["display_id"], r["raw_track_id"], r["kind"], r["count"]) for r in tk.track_reconnect(detections(spark, rows), rules).collect())
    state, want = tk.Tracks(rules), []
    for frame in sorted({r[0] for r in rows}):
        now = sorted((r for r in rows if r[0] == frame), key=lambda r: r[1])
        ds = [{"raw": r[1], "class_name": r[2], "family": "car_like", "cx": r[3], "cy": r[4], "width": r[5], "height": r[6]} for r in now]
        want += [(r["frame"], r["display_id"], r["raw_track_id"], r["kind"], r["count"]) for r in state.frame(frame, ds)]
    assert got == sorted(want)


def test_pairs_header(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("id,sent0,gold,sent1\n")
    with pytest.raises(ValueError):
        tb.read_pairs(spark, str(tmp_path / "bad.csv"))
