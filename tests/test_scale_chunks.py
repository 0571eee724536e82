"""Chunks of chapters leave a task's worker in bounded parts."""

import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.operators import graph_clean as gc


def test_chunks_are_handed_on_before_a_batch_ends(monkeypatch):
    monkeypatch.setattr(gc, "HANDED", 5000)
    bodies = [("A sentence of the chapter. " * 20 + "\n\n") * 2 + str(i) for i in range(200)] + [None, ""]
    parts = list(gc.chunk_lists(iter([pa.array(bodies, pa.string()), pa.array([], pa.string()), pa.array(["x"])]), 400, 50, True))
    assert max(sum(len(c) for cs in part.to_pylist() for c in cs) for part in parts) < 10_000
    assert [cs for part in parts for cs in part.to_pylist()] == [gc.chunk_chapter(b or "", 400, 50, True) for b in [*bodies, "x"]]


def test_chunk_rows_keep_their_chapters(spark):
    rows = [(i, 1 + i % 3, None if i % 50 == 0 else f"Paragraph {i}. " * (i % 90), i) for i in range(300)]
    chapters = spark.createDataFrame(rows, "doc_id int, chapter_no int, body string, position int")
    got = gc.chunk_text(chapters, 400, 50, compat=True).orderBy("doc_id", "chunk_idx").collect()
    want = [(i, c) for i, _, body, _ in rows for c in gc.chunk_chapter(body or "", 400, 50, True)]
    assert [(r.doc_id, r.chunk) for r in got] == want
