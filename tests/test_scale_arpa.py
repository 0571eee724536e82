"""Writing a model's file leaves nothing of the training on disk."""

import glob
import gzip
import os

from pyspark.sql import functions as F

from tallyloom.operators import ngram_model as nm
from tallyloom.plans import ngram_queries, registry
from tallyloom.session import checkpoint_root
from tallyloom.sources import arpa
from tallyloom.sources.corpus import sentences


def test_the_file_is_all_that_stays(spark, tmp_path):
    spark.createDataFrame([(0, "a b a c\nb a"), (1, "c a b"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = os.path.join(checkpoint_root(spark), "tables")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    path = ngram_queries._arpa_file(spark, str(tmp_path))
    assert set(os.listdir(folder)) == before
    parts = glob.glob(f"{path}/part-*")
    assert parts and all(p.endswith(".gz") for p in parts)
    lm = ngram_queries.doc_lm(spark, str(tmp_path))
    rows = lambda t: sorted((r["order"], r["words"], r["prob"], r["backoff"]) for r in t.collect())
    assert rows(arpa.read_arpa(spark, path)) == rows(lm)
    registry.forget_shared()


def test_gzip_members_make_the_same_file(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b a c\nb a x y z"), (1, "c a b")], "doc_id long, text string")
    lm = nm.train(sentences(docs), 3, nm.FALLBACK_DISCOUNTS)
    found = {}
    for codec in ("none", "gzip"):
        path = str(tmp_path / codec)
        arpa.write_arpa(lm, path, 3, codec)
        parts = [open(p, "rb").read() for p in sorted(glob.glob(f"{path}/part-*"))]
        found[codec] = b"".join(parts) if codec == "none" else gzip.decompress(b"".join(parts))
    lines = found["none"].decode().split("\n")
    assert found["gzip"] == found["none"] and lines[0] == "\\data\\" and lines[-2] == "\\end\\"
    entry = lm.filter(F.col("words") == "a b").first()
    assert f"{entry.prob}\ta b\t{entry.backoff}" in lines and not any(line.startswith("\t") for line in lines)
