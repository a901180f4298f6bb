"""The full run - scan, filter, index (reuse or build), classify, copy, report.

    run = dedupe(spark, "/data/ref", "/data/target", "/data/out",
                 index_dir="/shared/idx", results_dir="/shared/run-1", dry_run=False)
    run.stats.show()

Order of work (each step is a Spark job over whole tables; nothing row-sized
passes the driver):

1. list both trees (metadata only) and apply the name/dir/extension filters;
2. empty target -> empty results, zero stats, no index work;
3. exact + perceptual index of the ref: reused from ``index_dir`` when its
   fingerprint still matches, else built and persisted (this also cuts lineage);
4. classify the targets lazily (size-gated hash, exact lookup, banded
   near-duplicate join over distinct fingerprints);
5. not a dry run: copy plan against the output tree, then executors copy (files) or
   the accepted content is written as a table (in-table sides); copy failures are
   joined back into the results;
6. results are written once as Parquet, and the stats are metrics of that write; the CSV reads the
   *written* results, so the classification is not executed twice.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_CHUNK_SIZE, DEFAULT_THRESHOLD, RESULT_COLUMNS
from ..functions.providers import FingerprintProvider, column_fingerprint
from ..operators.classify import match_targets, to_results
from ..operators.copyplan import copy_plan, selection
from ..operators.filters import prepare_side
from ..operators.stats import observe_stats, observed_stats, run_stats
from ..session import materialise, scope, scratch_folder, sized
from ..sinks.results import RESULT_SCHEMA, write_accepted, write_results_csv, write_results_parquet
from ..sources.content import copy_files, hash_paths
from ..sources.filesystems import is_remote, mounted, tree_of
from ..sources.filetree import scan_tree
from ..sources.images import phash_provider
from .index import build_or_load


@dataclass
class DedupeRun:
    results: DataFrame
    stats: DataFrame
    plan: DataFrame | None
    results_dir: str | None
    index_reused: dict
    accepted_dir: str | None = None


def _norm(p: str) -> str:
    return p.rstrip("/") if is_remote(p) else os.path.realpath(mounted(p))


def validate_paths(ref: str, target: str, out: str | None) -> None:
    """Inputs exist; the output is neither an input nor inside one (``file:`` URIs included)."""
    for label, p in (("Reference", ref), ("Target", target)):
        try:
            there = tree_of(p).exists()
        except Exception as e:  # no such file system, no client for it, no answer
            raise ValueError(f"{label} directory cannot be opened: {p}: {e}") from e
        if not there:
            raise ValueError(f"{label} directory does not exist: {p}")
    if out is None:
        return
    r, t, o = _norm(ref), _norm(target), _norm(out)
    if o in (r, t):
        raise ValueError("Output directory cannot be the same as reference or target")
    if o.startswith(r.rstrip("/") + "/") or o.startswith(t.rstrip("/") + "/"):
        raise ValueError("Output directory cannot be inside reference or target")


def dedupe(
    spark: SparkSession,
    ref: str | DataFrame,
    target: str | DataFrame,
    out: str | None = None,
    *,
    index_dir: str | None = None,
    results_dir: str | None = None,
    threshold: int = DEFAULT_THRESHOLD,
    enable_phash: bool = True,
    fingerprint: FingerprintProvider | None = None,
    extensions=None,
    max_image_pixels: int | None = None,
    hash_algo: str = "blake2b",
    match_mode: str = "lsh",
    bands: int | None = None,
    dry_run: bool = True,
    rebuild_index: bool = False,
    chunk_size: int = DEFAULT_CHUNK_SIZE,
    existing: DataFrame | None = None,
    split_bytes: int | None = None,
) -> DedupeRun:
    """``existing`` (rel_path, size, content_hash): what the destination of an in-table run already holds.

    ``split_bytes``: files above it are read in ranges by many tasks each and compared by range keys; a matched one is
    reported with its digest, another one with the first digits of its key.

    What stays is below ``results_dir`` (a scratch folder unless given): table, CSV, plan, copies' outcome, accepted
    content.  Everything else that the run writes on the way is removed when it ends."""
    if isinstance(ref, str) and isinstance(target, str):
        validate_paths(ref, target, out)
    results_dir = results_dir or scratch_folder(spark, "results")
    with scope(spark):
        return _run(spark, ref, target, out, index_dir, results_dir, threshold, enable_phash, fingerprint, extensions, max_image_pixels,
                    hash_algo, match_mode, bands, dry_run, rebuild_index, chunk_size, existing, split_bytes)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return sized(df.sparkSession.read.schema(df.schema).parquet(path))


def _run(spark, ref, target, out, index_dir, results_dir, threshold, enable_phash, fingerprint, extensions, max_image_pixels,
         hash_algo, match_mode, bands, dry_run, rebuild_index, chunk_size, existing, split_bytes) -> DedupeRun:
    ref_root = ref if isinstance(ref, str) else "ref"
    ref_files = prepare_side(scan_tree(spark, ref) if isinstance(ref, str) else ref, extensions)
    tgt_files = prepare_side(scan_tree(spark, target) if isinstance(target, str) else target, extensions)
    out_dir = out or "out"
    in_table = "content" in tgt_files.columns
    if enable_phash and fingerprint is None:
        if isinstance(ref, str) and isinstance(target, str):
            fingerprint = phash_provider(spark, max_image_pixels)
        elif "fp" in ref_files.columns and "fp" in tgt_files.columns:
            fingerprint = column_fingerprint()
        else:
            raise ValueError("the near pass needs a fingerprint provider (or a column fp on both sides); pass enable_phash=False to go without")

    if tgt_files.isEmpty():  # R7: nothing to do, no index work
        empty = spark.createDataFrame([], RESULT_SCHEMA)
        return DedupeRun(empty, run_stats(empty), None, None, {})

    reused = {}
    exact_index = fp_index = None
    if index_dir:
        idx = build_or_load(
            spark,
            ref_files,
            index_dir,
            ref_path=_norm(ref_root) if isinstance(ref, str) else ref_root,
            algo=hash_algo,
            fingerprint=fingerprint,
            extensions=extensions,
            max_image_pixels=max_image_pixels,
            enable_near=enable_phash,
            rebuild=rebuild_index,
            chunk_size=chunk_size,
            split_bytes=split_bytes,
        )
        exact_index, fp_index, reused = idx.exact, idx.near, idx.reused

    matched = match_targets(
        None if exact_index is not None else ref_files,
        tgt_files,
        fingerprint=fingerprint if enable_phash else None,
        threshold=threshold,
        enable_near=enable_phash,
        match_mode=match_mode,
        bands=bands,
        algo=hash_algo,
        exact_index=exact_index,
        fp_index=fp_index if enable_phash else None,
        chunk_size=chunk_size,
        hash_all=not dry_run,
        split_bytes=split_bytes,
    )

    plan = accepted_dir = None
    if not dry_run:
        # Materialise the (narrow) selection once: the plan reads it several times.
        selected = materialise(selection(matched), "selected")
        if in_table:
            there = existing if existing is not None else spark.createDataFrame([], EXISTING_SCHEMA)
            plan = _written(copy_plan(selected, there, algo=hash_algo), f"{results_dir}/plan")
            accepted_dir = f"{results_dir}/accepted"
            write_accepted(tgt_files, plan, accepted_dir)
        else:
            there = _existing_tree(spark, out_dir, selected, hash_algo, chunk_size, split_bytes)
            read = lambda df, gate: hash_paths(df, algo=hash_algo, gate=gate, chunk_size=chunk_size, split_bytes=split_bytes)
            plan = _written(copy_plan(selected, there, algo=hash_algo, hash_sources=read), f"{results_dir}/plan")
            copy_files(plan, out_dir).write.mode("overwrite").parquet(f"{results_dir}/copied")
            outcome = sized(spark.read.parquet(f"{results_dir}/copied").select("src", "error"))
            plan = plan.join(outcome, "src", "left")

    results = to_results(matched, dry_run=dry_run, out_dir=out_dir, plan=plan)
    observed, results = observe_stats(results)
    write_results_parquet(results, f"{results_dir}/table")
    written = spark.read.schema(RESULT_SCHEMA).parquet(f"{results_dir}/table")
    write_results_csv(written, f"{results_dir}/results")
    return DedupeRun(written.select(*RESULT_COLUMNS), observed_stats(spark, observed), plan, results_dir, reused, accepted_dir)


EXISTING_SCHEMA = "rel_path string, size bigint, content_hash string"


def _existing_tree(spark: SparkSession, out_dir: str, selected: DataFrame, algo: str, chunk_size: int, split_bytes: int | None) -> DataFrame:
    """(rel_path, size, content_hash) of everything in the output tree - links and directories
    too, with no size: they occupy their name.  Only same-path, same-size collisions are
    hashed (the only ones the plan compares)."""
    if not tree_of(out_dir).exists():
        return spark.createDataFrame([], EXISTING_SCHEMA)
    tree = scan_tree(spark, out_dir, everything=True).select("path", "rel_path", "size")
    sizes = selected.select(F.col("rel_path"), F.col("size").alias("_sel_size"))
    gated = tree.join(sizes, "rel_path", "left").withColumn("_same", F.col("_sel_size") == F.col("size"))
    gated = gated.withColumn("_same", F.coalesce(F.col("_same"), F.lit(False)))
    return materialise(hash_paths(gated, algo=algo, gate="_same", chunk_size=chunk_size, split_bytes=split_bytes).select("rel_path", "size", "content_hash"), "existing")
