"""Queries over real file trees that Spark derives from the ``documents`` table.

Every document becomes one file below a folder of the shared checkpoint folder (FIXTURES.md's
layout, links among them), so the listing, the reading by path, the copying, the index that follows a tree
and the stream of a tree run as they do on a user's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import prepare_side
from ..session import materialise, qualified, scratch_folder
from ..sources.content import hash_paths
from ..sources.fixtures import documents_files, write_tree
from ..sources.filetree import scan_tree
from ..sources.treesource import read_tree
from .oracle_sql import OUT_DIR, TREE_EXTENSIONS, TREE_LEAST

#: Files of the document trees above this many bytes are read in ranges (on real trees: some hundred MB).
RANGE_BYTES = 1024


def _folder(spark: SparkSession, label: str) -> str:
    return qualified(spark, scratch_folder(spark, label)).replace("file://", "file:").removeprefix("file:")


def _write(files: DataFrame, root: str) -> None:
    write_tree(files, root).write.format("noop").mode("overwrite").save()


def _trees(spark: SparkSession, sf: str) -> tuple[str, str, str]:
    base = _folder(spark, "trees")
    files = documents_files(spark, sf)
    for side in ("ref", "target"):
        _write(files.filter(F.col("side") == side), f"{base}/{side}")
    return base, f"{base}/ref", f"{base}/target"


def tree_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Both trees through the data source, filters on name and size pushed into the listing."""
    _, ref, tgt = _trees(spark, sf)
    both = read_tree(spark, ref, side="ref").unionByName(read_tree(spark, tgt, side="target"))
    wanted = prepare_side(both).filter(F.col("ext").isin(*TREE_EXTENSIONS) & (F.col("size") >= TREE_LEAST))
    return wanted.select("side", "rel_path", "name", "ext", "size", F.unix_millis("mtime").alias("mtime_ms"))


def tree_run(spark: SparkSession, sf: str) -> DataFrame:
    """R5 on files: list, hash by path, classify, copy; each result with the digest of the file that the run put into the output tree."""
    from .dedupe import dedupe

    base, ref, tgt = _trees(spark, sf)
    run = dedupe(spark, ref, tgt, f"{base}/{OUT_DIR}", enable_phash=False, hash_algo="sha256", dry_run=False)
    there = hash_paths(scan_tree(spark, f"{base}/{OUT_DIR}").select("path", "rel_path"), algo="sha256")
    copied = there.select(F.col("rel_path").alias("target_path"), F.col("content_hash").alias("copied_sha256"))
    strip = lambda c, root: F.replace(F.col(c), F.lit(f"{root}/"), F.lit(""))
    rows = run.results.select(
        strip("target_path", tgt).alias("target_path"), "action", strip("match_path", ref).alias("match_path"), "match_type", "distance_or_hash",
        strip("reason", base).alias("reason"))
    return rows.join(copied, "target_path", "left")


def tree_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """As ``tree_run`` (dry), every file of over ``RANGE_BYTES`` read in ranges by several tasks; matched files with their digest."""
    from .dedupe import dedupe

    base, ref, tgt = _trees(spark, sf)
    run = dedupe(spark, ref, tgt, f"{base}/{OUT_DIR}", index_dir=f"{base}/index", enable_phash=False, hash_algo="sha256", split_bytes=RANGE_BYTES)
    strip = lambda c, root: F.replace(F.col(c), F.lit(f"{root}/"), F.lit(""))
    digest = F.when(F.col("action") == "exact_dup", F.col("distance_or_hash")).otherwise("")
    return run.results.select(
        strip("target_path", tgt).alias("target_path"), "action", strip("match_path", ref).alias("match_path"), "match_type", digest.alias("digest"))


def index_update(spark: SparkSession, sf: str) -> DataFrame:
    """The index of an earlier state of the ref (files missing, others since changed, some since removed), brought up to date by a delta."""
    from .index import exact_facts
    from .versions import refresh

    files, i = documents_files(spark, sf), F.col("doc_id")
    now = prepare_side(files.filter(F.col("side") == "ref"))
    edited = now.filter(i % 7 != 0).withColumn("content", F.when(i % 11 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    edited = edited.withColumn("size", F.octet_length("content").cast("bigint"))
    removed = prepare_side(files.filter((F.col("side") == "target") & (i % 30 == 1)))
    folder = _folder(spark, "versions")
    facts = exact_facts("sha256")
    refresh(spark, edited.unionByName(removed), folder, facts, ref_path="ref")
    got = refresh(spark, now, folder, facts, ref_path="ref")
    rows = got.version.rows().select("path", "size", "content_hash")
    return rows.withColumns({"n_changed": F.lit(got.changed).cast("bigint"), "n_gone": F.lit(got.gone).cast("bigint")})


def stream_files(spark: SparkSession, sf: str) -> DataFrame:
    """ST1 over files: the target tree grows in three drops, a query started anew after each classifies what is new against the index of the ref."""
    from ..streaming.classify_stream import read_stream_results, start_tree_stream
    from .index import build_or_load

    files, base = documents_files(spark, sf), _folder(spark, "tree-stream")
    ref = prepare_side(files.filter(F.col("side") == "ref"))
    index = build_or_load(spark, ref, f"{base}/index", ref_path="ref", algo="sha256")
    targets = materialise(files.filter(F.col("side") == "target"), "targets")
    for drop in range(3):
        _write(targets.filter(F.col("doc_id") % 3 == drop), f"{base}/target")
        start_tree_stream(spark, f"{base}/target", f"{base}/log", index, f"{base}/results", f"{base}/offsets", algo="sha256", out_dir=OUT_DIR).awaitTermination()
    path = F.replace(F.col("target_path"), F.lit(f"{base}/target/"), F.lit(""))
    return read_stream_results(spark, f"{base}/results").withColumn("target_path", path)


TREE_QUERIES = {"tree_scan": tree_scan, "tree_run": tree_run, "tree_ranges": tree_ranges, "index_update": index_update, "stream_files": stream_files}
