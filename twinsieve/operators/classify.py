"""Target classification (R4, P11, U2, J6, K4): one result row per target file.

Precedence, as in the mirrored tool: read error -> ``skipped``; byte-identical
ref file -> ``exact_dup``; perceptual match (images only, within threshold) ->
``phash_dup``; otherwise ``copied``.  The four branches are one left-join
chain with a ``CASE``, so the result is a disjoint bag with exactly one row
per target - identical target files that are absent from the ref are all
``copied`` (there is no de-duplication inside the target side).

Physical shape: the exact pass works on narrow rows written once (see
:mod:`.exact`); the non-exact images are fingerprinted, collapsed to distinct
fingerprints for the band join, and the answers are joined back by path.  In-table
content is fingerprinted in its scan - only the candidates where their paths fit a
broadcast, else every image - and joined as (path, fp); files of a tree are decoded only
where they are candidates.

Freshly computed fingerprint tables - the ref index and the target
``(path, fp)`` rows - are each read by several branches of the plan (band
join, hot-band refinement, join back by value), and Spark does not reuse the
exchanges of a tokenising/decoding subtree across them.  They are therefore
materialised once as narrow tables below the session's shared checkpoint folder:
computed once, lineage cut so a lost executor does not re-run fingerprinting, and of
known size, so that later joins pick their side by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CHUNK_SIZE, DEFAULT_THRESHOLD
from ..functions.hashing import hash_prefix
from ..functions.paths import destination
from ..functions.providers import FingerprintProvider
from ..session import broadcast_if_small, materialise
from .exact import exact_matches
from .filters import is_image
from .near import best_matches, fingerprint_index

RESULT_SCHEMA = (
    "target_path string, action string, match_path string, match_type string, "
    "distance_or_hash string, reason string"
)


def near_index(ref: DataFrame, fingerprint: FingerprintProvider) -> DataFrame:
    """R2: fingerprint index of the ref images (fp, ref_path, n_files)."""
    imgs = ref.filter(is_image("ext"))
    if "error" in imgs.columns:
        imgs = imgs.filter(F.col("error").isNull())
    return fingerprint_index(fingerprint(imgs))


def match_targets(
    ref: DataFrame,
    targets: DataFrame,
    *,
    fingerprint: FingerprintProvider | None = None,
    threshold: int = DEFAULT_THRESHOLD,
    enable_near: bool = True,
    match_mode: str = "lsh",
    bands: int | None = None,
    algo: str = "sha256",
    exact_index: DataFrame | None = None,
    fp_index: DataFrame | None = None,
    chunk_size: int = DEFAULT_CHUNK_SIZE,
    hash_all: bool = False,
    split_bytes: int | None = None,
) -> DataFrame:
    """Targets with ``size_hit``, ``content_hash``, ``exact_path``, ``near_path``, ``distance``."""
    ex = exact_matches(targets, ref, algo=algo, index=exact_index, chunk_size=chunk_size, hash_all=hash_all, split_bytes=split_bytes)
    if not (enable_near and (fingerprint is not None or fp_index is not None)):
        return ex.withColumn("near_path", F.lit(None).cast("string")).withColumn("distance", F.lit(None).cast("int"))
    idx = fp_index if fp_index is not None else materialise(near_index(ref, fingerprint), "near-index")
    tfp = candidate_fingerprints(targets, ex, fingerprint)
    best = best_matches(tfp, idx, threshold=threshold, mode=match_mode, bands=bands)
    near = tfp.join(best, "fp").select("path", "near_path", "distance")
    return ex.join(near, "path", "left")


def candidate_fingerprints(targets: DataFrame, ex: DataFrame, fingerprint: FingerprintProvider | None) -> DataFrame:
    """(path, fp) of the near pass's candidates: readable images without an exact match; written once."""
    cand = ex.filter(F.col("exact_path").isNull() & is_image("ext"))
    if "error" in cand.columns:
        cand = cand.filter(F.col("error").isNull())
    if fingerprint is None:
        return cand.select("path", "fp")
    if "content" in targets.columns:
        # In the scan, before any shuffle: content is never moved to the candidates.  Where their paths are
        # few enough (by their size in memory) they are broadcast into the scan and only they are fingerprinted;
        # otherwise every image is, and the narrow rows are joined.
        imgs, paths = targets.filter(is_image("ext")), materialise(cand.select("path"), "candidates")
        small = broadcast_if_small(paths)
        if small is not None:
            return materialise(fingerprint(imgs.join(small, "path", "left_semi")), "fingerprints")
        return materialise(fingerprint(imgs).join(paths, "path", "left_semi"), "fingerprints")
    return materialise(fingerprint(cand), "fingerprints")


def to_results(matched: DataFrame, *, dry_run: bool = True, out_dir: str = "out", plan: DataFrame | None = None) -> DataFrame:
    """The six result strings ('' for none).

    ``plan`` (from :func:`twinsieve.operators.copyplan.copy_plan`) supplies the real
    destination of copied rows when not a dry run; a row of it with ``error`` (the copy
    failed) is reported ``skipped``.
    """
    err = F.col("error") if "error" in matched.columns else F.lit(None).cast("string")
    exact = F.col("exact_path").isNotNull()
    near = F.col("near_path").isNotNull()
    h16 = F.coalesce(hash_prefix("content_hash"), F.lit(""))
    planned_dest = destination(out_dir, "rel_path")
    df = matched
    failed = F.lit(None).cast("string")
    if dry_run or plan is None:
        copied_reason = F.concat(F.lit("[DRY-RUN] Would copy to " if dry_run else "Copied to "), planned_dest)
    else:
        outcome = F.col("error") if "error" in plan.columns else F.lit(None).cast("string")
        df = matched.join(plan.select(F.col("src").alias("path"), "final_dst", outcome.alias("copy_error")), "path", "left")
        copied_reason = F.concat(F.lit("Copied to "), destination(out_dir, F.coalesce(F.col("final_dst"), F.col("rel_path"))))
        failed = F.when(~exact & ~near, F.col("copy_error"))
    problem = F.coalesce(err, failed)
    skipped = problem.isNotNull()
    skip_reason = F.when(F.startswith(problem, F.lit("Cannot stat file:")), problem).otherwise(F.concat(F.lit("Error: "), problem))
    return df.select(
        F.col("path").alias("target_path"),
        F.when(skipped, "skipped").when(exact, "exact_dup").when(near, "phash_dup").otherwise("copied").alias("action"),
        F.when(skipped, "").otherwise(F.coalesce(F.col("exact_path"), F.col("near_path"), F.lit(""))).alias("match_path"),
        F.when(skipped, "").when(exact, "exact").when(near, "phash").otherwise("none").alias("match_type"),
        F.when(skipped, "")
        .when(exact, hash_prefix("content_hash"))
        .when(near, F.col("distance").cast("string"))
        .otherwise(h16)
        .alias("distance_or_hash"),
        F.when(skipped, skip_reason)
        .when(exact, F.lit("Byte-identical match in reference"))
        .when(near, F.concat(F.lit("Perceptual match (distance="), F.col("distance").cast("string"), F.lit(")")))
        .otherwise(copied_reason)
        .alias("reason"),
    )


def classify(ref: DataFrame, targets: DataFrame, *, dry_run: bool = True, out_dir: str = "out", plan: DataFrame | None = None, **match_opts) -> DataFrame:
    """Results for already-filtered ref and target ``files`` frames."""
    return to_results(match_targets(ref, targets, **match_opts), dry_run=dry_run, out_dir=out_dir, plan=plan)
