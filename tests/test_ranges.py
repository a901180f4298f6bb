"""Large files read in ranges by many tasks, and run statistics as metrics of the write."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from twinsieve.operators.stats import observe_stats, observed_stats, run_stats
from twinsieve.plans.dedupe import dedupe
from twinsieve.sources.content import hash_paths, range_digests, range_keys
from twinsieve.sources.filetree import scan_tree

SPLIT = 1000


def _w(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture()
def large(tmpdir_path):
    """Files around the range size, with copies, a late difference and swapped ranges."""
    a, b = os.urandom(SPLIT), os.urandom(SPLIT)
    ref, tgt = f"{tmpdir_path}/ref", f"{tmpdir_path}/target"
    _w(f"{ref}/big.bin", (a + b) * 20 + b"end")
    _w(f"{ref}/edge.bin", a)
    _w(f"{ref}/over.bin", a + b"x")
    _w(f"{tgt}/copy.bin", (a + b) * 20 + b"end")
    _w(f"{tgt}/late.bin", (a + b) * 20 + b"enD")
    _w(f"{tgt}/swapped.bin", (b + a) * 20 + b"end")
    _w(f"{tgt}/edge.bin", a)
    _w(f"{tgt}/over.bin", a + b"x")
    _w(f"{tgt}/other.bin", b + a)
    return ref, tgt, tmpdir_path


def test_one_file_goes_to_many_tasks(spark, large):
    ref, _, _ = large
    one = scan_tree(spark, ref).filter("name = 'big.bin'").select("path", "size")
    got = range_digests(one, SPLIT).withColumn("task", F.spark_partition_id()).collect()
    with open(f"{ref}/big.bin", "rb") as f:
        data = f.read()
    assert {r.part: r.digest for r in got} == {i: hashlib.sha256(data[i * SPLIT : (i + 1) * SPLIT]).hexdigest() for i in range(41)}
    assert len({r.task for r in got}) > 3


def test_keys_tell_files_apart(spark, large):
    _, tgt, _ = large
    files = scan_tree(spark, tgt).select("path", "size")
    keys = {os.path.basename(r.path): r.content_hash for r in hash_paths(files, split_bytes=SPLIT).collect()}
    assert len(set(keys.values())) == 6 and len(keys) == 6
    assert keys["edge.bin"] == hash_paths(files.filter("path like '%/edge.bin'")).first().content_hash  # not above: the digest
    assert keys["over.bin"].endswith(f":{SPLIT}")
    changed = files.withColumn("size", F.col("size") + 5).filter("path like '%/over.bin'")
    row = range_keys(changed, SPLIT).first()
    assert row.range_key is None and "listed size" in row.range_error


@pytest.mark.parametrize("index", [False, True])
def test_same_classification(spark, large, index):
    ref, tgt, base = large
    rows = {}
    for split in (None, SPLIT):
        run = dedupe(spark, ref, tgt, f"{base}/out", enable_phash=False, split_bytes=split, index_dir=f"{base}/index" if index else None)
        rows[split] = {os.path.basename(r.target_path): r for r in run.results.collect()}
        assert run.stats.first().exact_duplicates == 3 and run.stats.first().copied == 3
        assert run.index_reused == ({"exact": False, "near": False} if index else {})  # keys of another setting are not reused
    for name, r in rows[None].items():
        got = rows[SPLIT][name]
        assert (got.action, got.match_path, got.reason) == (r.action, r.match_path, r.reason)
        if r.action == "exact_dup":
            assert got.distance_or_hash == r.distance_or_hash  # the digest of the file


def test_copies_with_ranges(spark, large):
    ref, tgt, base = large
    _w(f"{base}/out/late.bin", b"z" * 40003)  # another file of that size
    with open(f"{tgt}/swapped.bin", "rb") as f:
        _w(f"{base}/out/swapped.bin", f.read())
    run = dedupe(spark, ref, tgt, f"{base}/out", enable_phash=False, split_bytes=SPLIT, dry_run=False)
    ops = {os.path.basename(r.src): r.op for r in run.plan.collect()}
    assert ops == {"late.bin": "rename", "swapped.bin": "already_present", "other.bin": "write"}


def test_a_file_that_goes_is_skipped(spark, large):
    _, tgt, _ = large
    files = scan_tree(spark, tgt).select("path", "size", F.lit(None).cast("string").alias("error"))
    gone = files.withColumn("path", F.concat("path", F.lit(".gone")))
    for r in hash_paths(gone, split_bytes=SPLIT).collect():
        assert r.content_hash is None and r.error.startswith("Failed to hash")


def test_stats_are_metrics_of_the_write(spark, tmpdir_path):
    rows = [(f"p{i}", ["copied", "exact_dup", "phash_dup", "skipped"][i % 4 if i < 9 else 0]) for i in range(23)]
    df = spark.createDataFrame(rows, "target_path string, action string").repartition(5)
    observed, out = observe_stats(df)
    out.write.parquet(f"{tmpdir_path}/rows")
    got = observed_stats(spark, observed)
    assert got.collect() == run_stats(df).collect() and got.schema.fieldNames() == run_stats(df).schema.fieldNames()
    observed, out = observe_stats(df.limit(0))
    out.write.parquet(f"{tmpdir_path}/none")
    assert observed_stats(spark, observed).first().total_scanned == 0
