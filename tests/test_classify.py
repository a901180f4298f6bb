"""Flagship classification on the documents fixture (FIXTURES.md §4) and its invariants."""

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from twinsieve.functions.providers import text_simhash
from twinsieve.operators.classify import classify
from twinsieve.operators.filters import prepare_side
from twinsieve.operators.stats import run_stats
from twinsieve.sources.fixtures import documents_files


def _sides(spark, sf=SF0001):
    f = documents_files(spark, sf)
    return prepare_side(f.filter("side = 'ref'")), prepare_side(f.filter("side = 'target'"))


@pytest.mark.parametrize("mode,expected", [("lsh", (3, 13, 72)), ("complete", (3, 18, 67))])
def test_expected_counts(spark, mode, expected):
    ref, tgt = _sides(spark)
    res = classify(ref, tgt, fingerprint=text_simhash(), match_mode=mode)
    counts = {r.action: r.n for r in res.groupBy("action").agg(F.count("*").alias("n")).collect()}
    assert (counts.get("exact_dup", 0), counts.get("phash_dup", 0), counts.get("copied", 0)) == expected
    assert res.count() == 88 and res.select("target_path").distinct().count() == 88


def test_invariants(spark):
    ref, tgt = _sides(spark)
    res = classify(ref, tgt, fingerprint=text_simhash()).cache()
    for c in res.columns:
        assert res.filter(F.col(c).isNull()).count() == 0
    bad = res.filter(
        ((F.col("action") == "exact_dup") & (F.col("match_type") != "exact"))
        | ((F.col("action") == "phash_dup") & (F.col("match_type") != "phash"))
        | ((F.col("action") == "copied") & ((F.col("match_type") != "none") | (F.col("match_path") != "")))
    )
    assert bad.count() == 0
    near = res.filter("action = 'phash_dup'").select(F.col("distance_or_hash").cast("int").alias("d"))
    assert near.filter("d > 8").count() == 0
    assert res.filter("action = 'copied' AND distance_or_hash <> ''").count() == 2
    st = run_stats(res).first()
    assert st.total_scanned == st.copied + st.exact_duplicates + st.phash_duplicates + st.skipped == 88


def test_partitioning_does_not_change_output(spark):
    ref, tgt = _sides(spark)
    a = sorted(classify(ref, tgt, fingerprint=text_simhash()).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(classify(ref.repartition(5), tgt.repartition(2), fingerprint=text_simhash()).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_identical_targets_absent_from_ref_are_all_copied(spark):
    ref = spark.createDataFrame([("r/a.jpg", "r/a.jpg", "a.jpg", ".jpg", 3, "xyz")], "path string, rel_path string, name string, ext string, size long, content string")
    tgt = spark.createDataFrame(
        [("t/1.mov", "1.mov", "1.mov", ".mov", 3, "abc"), ("t/2.mov", "2.mov", "2.mov", ".mov", 3, "abc"), ("t/3.mov", "3.mov", "3.mov", ".mov", 3, "xyz")],
        "path string, rel_path string, name string, ext string, size long, content string",
    )
    res = {r.target_path: (r.action, r.match_path) for r in classify(ref, tgt, fingerprint=text_simhash()).collect()}
    assert res == {"t/1.mov": ("copied", ""), "t/2.mov": ("copied", ""), "t/3.mov": ("exact_dup", "r/a.jpg")}


def test_bytes_only_has_no_near(spark):
    ref, tgt = _sides(spark)
    res = classify(ref, tgt, enable_near=False)
    assert res.filter("action = 'phash_dup'").count() == 0
    assert res.filter("action = 'exact_dup'").count() == 3
