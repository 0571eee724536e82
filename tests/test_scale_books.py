"""Books are kept in few files, whatever their number."""

import os

from tallyloom.sources import triples as tr


def test_books_share_files(spark, tmp_path):
    rows = [(i, f"\nhead {i}\nline") for i in range(300)] + [(7, "\nsecond"), (300, ""), (301, None), (302, "a\u0001b")]
    path = str(tmp_path / "books")
    tr.write_books(spark.createDataFrame(rows, "id bigint, text string"), path, "id", "text")
    files = [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = dict(r["text"].split("\n", 1) for r in tr.read_books(spark, path, tr.BOOK_END).collect())
    want = {str(i): f"\nhead {i}\nline" for i in range(300)} | {"7": "\nhead 7\nline\nsecond", "300": "", "301": "", "302": "ab"}
    assert read == want


def test_a_file_is_a_book_without_an_end_mark(spark, tmp_path):
    (tmp_path / "b.txt").write_text("x\u0001y\nz")
    assert [r["text"] for r in tr.read_books(spark, str(tmp_path)).collect()] == ["x\u0001y\nz"]
