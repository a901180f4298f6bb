"""Spark query for every inventory item, on the driver tables (``queries()``).

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
column names and types equal the DuckDB statement of the same key in
:mod:`twinsieve.plans.oracle_sql`.  All run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_THRESHOLD
from ..functions.fingerprints import chunk_columns, simhash_table, with_median_bits
from ..functions.hashing import content_hash
from ..functions.paths import parent_of, stem_of, suffix_of
from ..functions.providers import text_simhash
from ..operators import exact as X
from ..operators import near as N
from ..operators import stats as S
from ..operators.classify import candidate_fingerprints, classify, match_targets, near_index
from ..operators.copyplan import copy_plan, selection
from ..operators.filters import drop_ignored, filter_extensions, is_image, prepare_side
from ..session import materialise, scratch_folder, sized
from ..sources.fixtures import documents_files, existing_destinations
from ..sources.tables import read_table, spread
from .oracle_sql import EXT_FILTER_SPEC, OUT_DIR
from .tree_queries import TREE_QUERIES

Query = Callable[[SparkSession, str], DataFrame]
REF_ROOT = "ref"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return documents_files(spark, sf)


def _sides(spark: SparkSession, sf: str, extensions=None) -> tuple[DataFrame, DataFrame]:
    f = _files(spark, sf)
    return prepare_side(f.filter(F.col("side") == "ref"), extensions), prepare_side(f.filter(F.col("side") == "target"), extensions)


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_folder(spark, name) + "/data"


# --- scans, filters, scalars --------------------------------------------------

def file_manifest(spark, sf):
    return _files(spark, sf).select("side", "path", "rel_path", "name", "ext", "size", F.unix_millis("mtime").alias("mtime_ms"))


def filter_ignored(spark, sf):
    return drop_ignored(_files(spark, sf)).select("side", "path", "name", "ext", "size")


def filter_extensions_q(spark, sf):
    ref, tgt = _sides(spark, sf, EXT_FILTER_SPEC)
    return ref.unionByName(tgt).select("side", "path", "ext")


def image_files(spark, sf):
    ref, tgt = _sides(spark, sf)
    return ref.unionByName(tgt).filter(is_image("ext")).select("side", "path", "ext")


def path_parts(spark, sf):
    f = _files(spark, sf)
    return f.select(
        "path", "name", parent_of("path").alias("parent"), stem_of("name").alias("stem"), suffix_of("name").alias("suffix"), "ext"
    )


# --- exact pass ---------------------------------------------------------------

def size_buckets(spark, sf):
    ref, _ = _sides(spark, sf)
    return X.size_buckets(ref)


def content_hash_q(spark, sf):
    ref, tgt = _sides(spark, sf)
    both = ref.unionByName(tgt)
    return both.select("side", "path", "size", content_hash("content", "sha256").alias("content_hash"))


def content_hash_blake2b(spark, sf):
    """P5 with blake2b: the digest's length and the smallest path that shares it (what an oracle without
    blake2b can derive from equal contents)."""
    ref, tgt = _sides(spark, sf)
    rows = ref.unionByName(tgt).select("side", "path", "size", content_hash("content", "blake2b").alias("digest"))
    rows.write.parquet(where := _scratch(spark, "blake2b"))  # narrow rows, hashed once
    rows = spark.read.parquet(where)
    first = rows.groupBy("digest").agg(F.min("path").alias("first_path"))
    return rows.join(first, "digest").select("side", "path", "size", F.length("digest").alias("digest_chars"), "first_path")


def hash_groups(spark, sf):
    ref, _ = _sides(spark, sf)
    return X.hash_groups(X.hash_index(ref))


def size_semi_join(spark, sf):
    ref, tgt = _sides(spark, sf)
    return X.size_semi_join(tgt, ref).select("path", "size")


def exact_duplicates(spark, sf):
    ref, tgt = _sides(spark, sf)
    m = X.exact_matches(tgt, ref)
    return m.filter(F.col("exact_path").isNotNull()).select(
        F.col("path").alias("target_path"), F.col("exact_path").alias("match_path"), "content_hash"
    )


def classify_bytes_only(spark, sf):
    ref, tgt = _sides(spark, sf)
    return classify(ref, tgt, enable_near=False, out_dir=OUT_DIR)


# --- fingerprints ---------------------------------------------------------------

def fingerprint64(spark, sf):
    docs = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    fp = simhash_table(docs, "doc_id", "text")
    return fp.select("doc_id", *chunk_columns("fp"))


def fingerprint64_vectors(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return with_median_bits(emb.select("vec_id", "embedding"), "embedding").select("vec_id", *chunk_columns("fp"))


def _near_setup(spark, sf):
    ref, tgt = _sides(spark, sf)
    fp = text_simhash()
    # Both sides feed several joins: fingerprint each once (see operators.classify).
    idx = materialise(near_index(ref, fp), "near-index")
    tfp = candidate_fingerprints(tgt, X.exact_matches(tgt, ref), fp)
    return idx, tfp.filter(F.col("fp").isNotNull())


def phash_groups(spark, sf):
    ref, _ = _sides(spark, sf)
    idx = near_index(ref, text_simhash())
    return idx.select(*chunk_columns("fp"), "n_files", "ref_path")


def chunk_index(spark, sf):
    ref, _ = _sides(spark, sf)
    return N.chunk_index(near_index(ref, text_simhash()))


def phash_exact_match(spark, sf):
    idx, tfp = _near_setup(spark, sf)
    return tfp.join(idx, "fp").select(F.col("path").alias("target_path"), F.col("ref_path").alias("match_path"))


def lsh_candidates(spark, sf):
    idx, tfp = _near_setup(spark, sf)
    return N.candidates(tfp, idx, mode="lsh", label="path").select(F.col("path").alias("target_path"), "ref_path", "distance")


def candidate_counts(spark, sf):
    idx, tfp = _near_setup(spark, sf)
    return N.candidate_counts(tfp, idx, mode="lsh").withColumnRenamed("path", "target_path")


def best_perceptual_match(spark, sf):
    idx, tfp = _near_setup(spark, sf)
    best = N.best_matches(tfp, idx, threshold=DEFAULT_THRESHOLD, mode="lsh")
    return tfp.join(best, "fp").select(F.col("path").alias("target_path"), F.col("near_path").alias("match_path"), "distance")


def hamming_complete(spark, sf):
    idx, tfp = _near_setup(spark, sf)
    best = N.best_matches(tfp, idx, threshold=DEFAULT_THRESHOLD, mode="complete")
    return tfp.join(best, "fp").select(F.col("path").alias("target_path"), F.col("near_path").alias("match_path"), "distance")


# --- index lifecycle --------------------------------------------------------------

def reference_fingerprint(spark, sf):
    ref, _ = _sides(spark, sf)
    return S.reference_fingerprint(ref, REF_ROOT).select(
        "ref_path", "file_count", "total_bytes", F.unix_millis("max_mtime").alias("max_mtime_ms")
    )


def fingerprints_match(spark, sf):
    """Store the ref fingerprint, read it back, compare against derived tree states."""
    from .index import read_fingerprint, write_fingerprint

    ref, tgt = _sides(spark, sf)
    stored_at = _scratch(spark, "fingerprint")
    write_fingerprint(S.reference_fingerprint(ref, REF_ROOT), stored_at)
    stored = read_fingerprint(spark, stored_at)
    newest = ref.agg(F.max("mtime").alias("m"))
    touched = ref.join(newest, F.col("mtime") == F.col("m"), "left").withColumn(
        "mtime", F.when(F.col("m").isNotNull(), F.col("mtime") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("mtime"))
    )
    states = {
        "unchanged": ref,
        "newest_touched": touched,
        "images_only": ref.filter(is_image("ext")),
        "target_tree": tgt,
    }
    out = None
    for name, df in states.items():
        row = S.fingerprints_equal(stored, S.reference_fingerprint(df, REF_ROOT)).select(F.lit(name).alias("state"), "matches")
        out = row if out is None else out.unionByName(row)
    return out


def index_stats(spark, sf):
    ref, _ = _sides(spark, sf)
    return S.index_stats(ref, X.hash_index(ref), near_index(ref, text_simhash()))


def index_roundtrip(spark, sf):
    """Build the exact index, persist it as Parquet in the shared folder, read it back."""
    from .index import build_or_load

    ref, _ = _sides(spark, sf)
    idx = build_or_load(spark, ref, _scratch(spark, "index"), ref_path=REF_ROOT, algo="sha256", fingerprint=None)
    return idx.exact.select("content_hash", "size", "path")


# --- classification and outputs -------------------------------------------------------

def classify_q(spark, sf):
    ref, tgt = _sides(spark, sf)
    return classify(ref, tgt, fingerprint=text_simhash(), threshold=DEFAULT_THRESHOLD, match_mode="lsh", out_dir=OUT_DIR)


def classify_complete(spark, sf):
    ref, tgt = _sides(spark, sf)
    return classify(ref, tgt, fingerprint=text_simhash(), threshold=DEFAULT_THRESHOLD, match_mode="complete", out_dir=OUT_DIR)


def run_stats(spark, sf):
    return S.run_stats(classify_q(spark, sf))


def unique_rows(spark, sf):
    """Targets with neither an exact nor a perceptual match (bag semantics)."""
    ref, tgt = _sides(spark, sf)
    m = match_targets(ref, tgt, fingerprint=text_simhash())
    return m.filter(F.col("exact_path").isNull() & F.col("near_path").isNull()).select("path", "rel_path", "size")


def copy_plan_q(spark, sf):
    ref, tgt = _sides(spark, sf)
    m = match_targets(ref, tgt, fingerprint=text_simhash(), hash_all=True)
    # The plan reads the selection several times (collision join, occupied names,
    # renames): materialise its narrow rows once in the shared checkpoint folder.
    selected = materialise(selection(m), "selected")
    existing = materialise(existing_destinations(tgt), "existing")
    return copy_plan(selected, existing)


def _unreadable(tgt: DataFrame) -> DataFrame:
    """The full run's fixture: some targets cannot be read."""
    bad = F.col("doc_id") % 50 == 21
    return tgt.withColumn("error", F.when(bad, F.concat(F.lit("Failed to hash "), F.col("path"), F.lit(": unreadable"))))


def _run(spark, sf):
    """R5 in full on the fixture: index, classification, copy plan, accepted-content sink, results, stats."""
    from .dedupe import dedupe

    ref, tgt = _sides(spark, sf)
    existing = materialise(existing_destinations(tgt), "existing")
    return dedupe(spark, ref, _unreadable(tgt), OUT_DIR, index_dir=_scratch(spark, "run-index"), fingerprint=text_simhash(),
                  hash_algo="sha256", dry_run=False, existing=existing)


def dedupe_run(spark, sf):
    """The results of a full run, joined back to the content it accepted."""
    run = _run(spark, sf)
    kept = sized(spark.read.parquet(run.accepted_dir).select(F.col("src").alias("target_path"), F.sha2("content", 256).alias("accepted_sha256")))
    return run.results.join(kept, "target_path", "left")


def accepted_content(spark, sf):
    """K3: the accepted-content table of a full run."""
    kept = spark.read.parquet(_run(spark, sf).accepted_dir)
    return kept.select("rel_path", "src", "size", F.sha2("content", 256).alias("sha256"), F.unix_millis("mtime").alias("mtime_ms"))


def results_csv_roundtrip(spark, sf):
    from ..sinks.results import read_results_csv, write_results_csv

    path = _scratch(spark, "results-csv")
    write_results_csv(classify_q(spark, sf), path)
    return read_results_csv(spark, path)


def stream_classify(spark, sf):
    from ..streaming.classify_stream import classify_documents_stream

    return classify_documents_stream(spark, sf, _scratch(spark, "stream"), out_dir=OUT_DIR)


def all_queries() -> dict[str, Query]:
    return TREE_QUERIES | {
        "file_manifest": file_manifest,
        "filter_ignored": filter_ignored,
        "filter_extensions": filter_extensions_q,
        "image_files": image_files,
        "path_parts": path_parts,
        "size_buckets": size_buckets,
        "content_hash": content_hash_q,
        "content_hash_blake2b": content_hash_blake2b,
        "hash_groups": hash_groups,
        "size_semi_join": size_semi_join,
        "exact_duplicates": exact_duplicates,
        "unique_rows": unique_rows,
        "classify_bytes_only": classify_bytes_only,
        "fingerprint64": fingerprint64,
        "fingerprint64_vectors": fingerprint64_vectors,
        "phash_groups": phash_groups,
        "chunk_index": chunk_index,
        "phash_exact_match": phash_exact_match,
        "lsh_candidates": lsh_candidates,
        "candidate_counts": candidate_counts,
        "best_perceptual_match": best_perceptual_match,
        "hamming_complete": hamming_complete,
        "reference_fingerprint": reference_fingerprint,
        "fingerprints_match": fingerprints_match,
        "index_stats": index_stats,
        "index_roundtrip": index_roundtrip,
        "classify": classify_q,
        "classify_complete": classify_complete,
        "run_stats": run_stats,
        "copy_plan": copy_plan_q,
        "dedupe_run": dedupe_run,
        "accepted_content": accepted_content,
        "results_csv_roundtrip": results_csv_roundtrip,
        "stream_classify": stream_classify,
        "image_phash": image_phash,
    }


def image_phash(spark, sf):
    """S3 + P7 on images Spark derives from the ``embeddings`` table: every vector is
    rendered as a greyscale PNG by the executors into the shared folder, decoded by
    the ``image`` source and hashed.  Every image decodes, equal vectors give equal fingerprints
    (``first_equal`` groups by both), and the bits (as chunks) are those that SQL works out from the vectors."""
    from ..sources.images import image_fingerprints, write_vector_images

    folder = _scratch(spark, "images")
    vectors = read_table(spark, sf, "embeddings").select("vec_id", "embedding")
    written = write_vector_images(vectors, folder)
    written.write.mode("overwrite").parquet(folder + "-manifest")
    fps = image_fingerprints(spark, folder)
    manifest = spark.read.parquet(folder + "-manifest")
    hashed = manifest.join(fps, "path", "left").join(vectors, "vec_id").select("vec_id", "embedding", "fp")
    first = hashed.groupBy("embedding", "fp").agg(F.min("vec_id").alias("first_equal"))
    return hashed.join(first, ["embedding", "fp"]).select("vec_id", F.col("fp").isNotNull().alias("decoded"), "first_equal", *chunk_columns("fp"))
