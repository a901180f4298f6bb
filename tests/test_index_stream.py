"""Index reuse / invalidation and the streaming classifier."""

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from twinsieve.functions.providers import text_simhash
from twinsieve.operators.classify import classify
from twinsieve.operators.filters import prepare_side
from twinsieve.plans.index import build_or_load
from twinsieve.sources.fixtures import documents_files
from twinsieve.streaming.classify_stream import classify_documents_stream


def _ref(spark):
    return prepare_side(documents_files(spark, SF0001).filter("side = 'ref'"))


def test_reuse_and_invalidation(spark, tmpdir_path):
    ref = _ref(spark)
    fp = text_simhash()
    d = f"{tmpdir_path}/idx"
    a = build_or_load(spark, ref, d, ref_path="ref", fingerprint=fp)
    assert a.reused == {"exact": False, "near": False}
    b = build_or_load(spark, ref, d, ref_path="ref", fingerprint=fp)
    assert b.reused == {"exact": True, "near": True}
    assert sorted(a.exact.collect()) == sorted(b.exact.collect())
    # newest file touched -> both tables rebuilt
    newest = ref.agg(F.max("mtime").alias("m")).first().m
    touched = ref.withColumn("mtime", F.when(F.col("mtime") == F.lit(newest), F.col("mtime") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("mtime")))
    c = build_or_load(spark, touched, d, ref_path="ref", fingerprint=fp)
    assert c.reused == {"exact": False, "near": False}
    # other options (extension filter, hash algorithm) -> not reused
    e = build_or_load(spark, touched, d, ref_path="ref", fingerprint=fp, algo="blake2b")
    assert e.reused["exact"] is False and e.reused["near"] is True
    # forced rebuild
    f = build_or_load(spark, touched, d, ref_path="ref", fingerprint=fp, algo="blake2b", rebuild=True)
    assert f.reused == {"exact": False, "near": False}
    # the near table is per-fingerprint: disabling it and changing the ref does not leave it stale
    g = build_or_load(spark, ref, d, ref_path="ref", fingerprint=fp, enable_near=False, algo="blake2b")
    h = build_or_load(spark, ref, d, ref_path="ref", fingerprint=fp, algo="blake2b")
    assert g.reused["exact"] is False and h.reused["near"] is False


def test_stream_equals_batch(spark, tmpdir_path):
    f = documents_files(spark, SF0001)
    ref, tgt = prepare_side(f.filter("side = 'ref'")), prepare_side(f.filter("side = 'target'"))
    batch = sorted(classify(ref, tgt, fingerprint=text_simhash()).collect())
    scratch = f"{tmpdir_path}/stream"
    streamed = sorted(classify_documents_stream(spark, SF0001, scratch).collect())
    assert streamed == batch
    # restarting from the same checkpoint adds no rows
    again = classify_documents_stream(spark, SF0001, scratch).count()
    assert again == len(batch)


def test_cluster_without_shared_checkpoint_folder_is_refused():
    from types import SimpleNamespace

    from twinsieve.session import ensure_checkpoint_dir

    conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda *a: None)
    sc = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=sc))


def test_documents_stream_over_part_files(spark, tmpdir_path):
    """The table as a folder of part files gives the rows of the table as one file."""
    from twinsieve.sources.tables import table_path
    from twinsieve.streaming.classify_stream import classify_documents_stream

    docs = spark.read.parquet(table_path("/root/testdata/sf0.001", "documents"))
    docs.repartition(6).write.parquet(f"{tmpdir_path}/parts/documents.parquet")
    got = classify_documents_stream(spark, f"{tmpdir_path}/parts", f"{tmpdir_path}/a")
    want = classify_documents_stream(spark, "/root/testdata/sf0.001", f"{tmpdir_path}/b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
