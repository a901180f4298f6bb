"""Reference index lifecycle.

The index is two versioned tables (see :mod:`.versions`) in a shared folder, one row a ref file:

    <index_dir>/exact   path, size, mtime, content_hash, error
    <index_dir>/near    path, size, mtime, fp                    (images)

A table is reused as it is iff no rebuild is forced and its tree fingerprint equals
the current one (ref path, file count, total bytes, newest mtime and the
options that shape the table: hash algorithm, extension filter, fingerprint
kind, pixel limit).  Otherwise only the files that are new or have another size or time
are read again and the change is committed as a delta; other options or another root start anew.
An empty near table is a valid index (D11).

Reading the index back from the written files also cuts the lineage: later
stages never recompute hashes from the raw tree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..config import DEFAULT_CHUNK_SIZE
from ..functions.hashing import content_hash
from ..operators.filters import is_image, normalise_extensions
from ..operators.near import fingerprint_index
from ..operators.stats import FINGERPRINT_FIELDS
from .versions import MAX_GENERATIONS, Refreshed, refresh

FINGERPRINT_SCHEMA = "ref_path string, file_count bigint, total_bytes bigint, max_mtime timestamp, options string"


@dataclass
class ReferenceIndex:
    exact: DataFrame
    near: DataFrame | None
    reused: dict = field(default_factory=dict)
    #: By table: files worked out anew, files removed.
    changes: dict = field(default_factory=dict)


def write_fingerprint(fp: DataFrame, path: str) -> None:
    fp.select(*FINGERPRINT_FIELDS).coalesce(1).write.mode("overwrite").parquet(path)


def read_fingerprint(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored fingerprint, or None when missing or unreadable (-> rebuild)."""
    try:
        return spark.read.schema(FINGERPRINT_SCHEMA).parquet(path)
    except AnalysisException:
        return None


def _only(files: DataFrame, todo: DataFrame | None) -> DataFrame:
    return files if todo is None else files.join(todo, "path", "left_semi")


def exact_facts(algo: str, chunk_size: int = DEFAULT_CHUNK_SIZE, split_bytes: int | None = None):
    """(path, size, mtime, content_hash, error) of files: read by path, or hashed in the scan of in-table content."""

    def facts(files: DataFrame, todo: DataFrame | None) -> DataFrame:
        error = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
        if "content" in files.columns:  # before any join: content is never shuffled
            digest = F.when(error.isNull(), content_hash("content", algo))
            return _only(files.select("path", "size", "mtime", digest.alias("content_hash"), error.alias("error")), todo)
        from ..sources.content import hash_paths

        narrow = _only(files.select("path", "size", "mtime", error.alias("error")), todo)
        return hash_paths(narrow, algo=algo, chunk_size=chunk_size, split_bytes=split_bytes).select("path", "size", "mtime", "content_hash", "error")

    return facts


def near_facts(fingerprint):
    """(path, size, mtime, fp) of images; fp is NULL where there is none."""

    def facts(files: DataFrame, todo: DataFrame | None) -> DataFrame:
        narrow = _only(files.select("path", "size", "mtime"), todo)
        if "content" in files.columns:
            return narrow.join(fingerprint(files).select("path", "fp"), "path", "left")
        return narrow.join(fingerprint(_only(files, todo)).select("path", "fp"), "path", "left")

    return facts


def build_or_load(
    spark: SparkSession,
    ref: DataFrame,
    index_dir: str,
    *,
    ref_path: str,
    algo: str = "sha256",
    fingerprint=None,
    fingerprint_name: str | None = None,
    extensions=None,
    max_image_pixels: int | None = None,
    enable_near: bool = True,
    rebuild: bool = False,
    verify: bool = False,
    max_generations: int = MAX_GENERATIONS,
    chunk_size: int = DEFAULT_CHUNK_SIZE,
    split_bytes: int | None = None,
) -> ReferenceIndex:
    """Reuse each index table, bring it up to date or build it; ``ref`` is the filtered ref ``files`` frame."""
    exts = ",".join(normalise_extensions(extensions) or ())
    index_dir = index_dir.rstrip("/")
    split = f";split={split_bytes}" if split_bytes else ""
    how = {"ref_path": ref_path, "tree_of": ref, "rebuild": rebuild, "verify": verify, "max_generations": max_generations}
    got: dict[str, Refreshed] = {}
    got["exact"] = refresh(spark, ref, f"{index_dir}/exact", exact_facts(algo, chunk_size, split_bytes), options=f"algo={algo};ext={exts}{split}",
                           retry="error IS NOT NULL", **how)
    exact = got["exact"].version.rows().filter(F.col("content_hash").isNotNull()).select("content_hash", "size", "path")
    near = None
    if enable_near and fingerprint is not None:
        name = fingerprint_name or getattr(fingerprint, "__name__", "fingerprint")
        imgs = ref.filter(is_image("ext"))
        if "error" in imgs.columns:
            imgs = imgs.filter(F.col("error").isNull())
        got["near"] = refresh(spark, imgs, f"{index_dir}/near", near_facts(fingerprint), options=f"fp={name};ext={exts};max_pixels={max_image_pixels}", **how)
        near = fingerprint_index(got["near"].version.rows().select("path", "fp"))
    return ReferenceIndex(exact=exact, near=near, reused={"exact": got["exact"].reused, "near": "near" in got and got["near"].reused},
                          changes={k: (v.changed, v.gone) for k, v in got.items()})
