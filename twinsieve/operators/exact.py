"""Byte-identical matching: size buckets, content-hash index, the size-gated hash
and the exact lookup (A1, A2, F6/J1, P5/P6, J2).

Plan shape (why it is written this way):

* Sizes are metadata; the ref's distinct sizes are joined onto the targets
  without a hint.  AQE turns the join into a broadcast when the runtime size
  of the distinct-size side is under the broadcast threshold, and keeps a
  shuffle join otherwise - the broadcast is always behind a measured size.
* In-table content becomes a hash in the scan; files are hashed by path only where
  the size matched.  Joins carry narrow rows, never content.
* The exact lookup side is pre-aggregated to one row per hash (smallest path),
  so a hash shared by a third of the ref is one row and the target side of the
  join can be split by AQE's skew handling without multiplying output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_CHUNK_SIZE
from ..functions.hashing import content_hash
from ..session import broadcast_if_small, materialise


def ref_sizes(ref: DataFrame) -> DataFrame:
    return ref.select("size").distinct()


def size_buckets(ref: DataFrame) -> DataFrame:
    """A1: ref files per size."""
    return ref.groupBy("size").agg(F.count(F.lit(1)).alias("n_files"))


def size_semi_join(targets: DataFrame, ref: DataFrame) -> DataFrame:
    """Targets whose size occurs among ref sizes."""
    return targets.join(ref_sizes(ref), "size", "left_semi")


def flag_size_hits(targets: DataFrame, ref: DataFrame, distinct: bool = False) -> DataFrame:
    """Adds boolean ``size_hit`` (size occurs in ``ref``, a frame with ``size``, each once if ``distinct``) without dropping rows."""
    hits = ref.withColumn("size_hit", F.lit(True)) if distinct else ref_sizes(ref).withColumn("size_hit", F.lit(True))
    return targets.join(hits, "size", "left").withColumn("size_hit", F.coalesce(F.col("size_hit"), F.lit(False)))


def narrow_rows(files: DataFrame, algo: str = "sha256", gate=None) -> DataFrame:
    """``files`` without ``content``: one scan turns in-table content into ``full_hash``, so
    no join or shuffle ever carries file bytes; with a ``gate`` only where it holds.  Frames without content pass through."""
    if "content" not in files.columns:
        return files
    digest = content_hash(F.col("content") if gate is None else F.when(gate, F.col("content")), algo)
    return files.select(*[c for c in files.columns if c != "content"], digest.alias("full_hash"))


def hash_index(ref: DataFrame, algo: str = "sha256", chunk_size: int = DEFAULT_CHUNK_SIZE, split_bytes: int | None = None) -> DataFrame:
    """The exact index, one row per readable ref file: (content_hash, size, path)."""
    if "content" in ref.columns:
        # Filter on the content, not on its hash: the filter would be pushed below the
        # projection and the hash computed twice.
        readable = ref.filter(F.col("content").isNotNull())
        if "error" in ref.columns:
            readable = readable.filter(F.col("error").isNull())
        return readable.select(content_hash("content", algo).alias("content_hash"), "size", "path")
    from ..sources.content import hash_paths

    hashed = hash_paths(ref, algo=algo, chunk_size=chunk_size, split_bytes=split_bytes)
    return hashed.filter(F.col("error").isNull() & F.col("content_hash").isNotNull()).select("content_hash", "size", "path")


def hash_groups(index: DataFrame) -> DataFrame:
    """A2: one row per hash with its size, number of ref paths and the reported (smallest) path.

    No path list is collected: a hash shared by a third of all files would put
    that whole list in one row and one task.
    """
    return index.groupBy("content_hash").agg(
        F.min("size").alias("size"),
        F.count(F.lit(1)).alias("n_paths"),
        F.min("path").alias("first_path"),
    )


def exact_lookup(index: DataFrame) -> DataFrame:
    """(content_hash, exact_path) - the smallest ref path per hash."""
    return index.groupBy("content_hash").agg(F.min("path").alias("exact_path"))


def exact_matches(
    targets: DataFrame,
    ref: DataFrame | None,
    algo: str = "sha256",
    index: DataFrame | None = None,
    chunk_size: int = DEFAULT_CHUNK_SIZE,
    hash_all: bool = False,
    split_bytes: int | None = None,
) -> DataFrame:
    """Size-gated hash of the targets and the exact lookup, on narrow rows.

    Adds ``size_hit``, ``content_hash`` (NULL when the size does not occur) and
    ``exact_path`` (NULL when no byte-identical ref file exists); ``content`` is
    replaced by ``full_hash``.  The hashed rows are written once: every
    file is read and hashed once, whatever reads them later.  Rows without a
    size match - normally most - go round the hash join by ``union``, so they never
    meet in one partition as a NULL key.  With a persisted ``index`` the size buckets
    come from it (readable ref files only, as in the mirrored tool) and ``ref`` may be None.
    ``hash_all``: ``full_hash`` of every in-table row, for a copy plan that compares it with destinations.
    ``split_bytes``: larger files are compared by range keys (many tasks a file; an ``index`` must have been
    made with the same setting); those that match get their digest afterwards, the others keep the key.
    """
    idx = index if index is not None else hash_index(ref, algo, chunk_size, split_bytes)
    sized = (idx if index is not None else ref).select("size")
    if "content" in targets.columns:
        sizes = materialise(ref_sizes(sized), "sizes")
        small = None if hash_all else broadcast_if_small(sizes)
        if small is not None:  # in the scan: only content of a size that occurs is hashed
            flagged = narrow_rows(flag_size_hits(targets, small, distinct=True), algo, F.col("size_hit"))
        else:
            flagged = flag_size_hits(narrow_rows(targets, algo), sizes, distinct=True)
        hashed = flagged.withColumn("content_hash", F.when(F.col("size_hit"), F.col("full_hash")))
    else:
        flagged = flag_size_hits(targets, sized)
        from ..sources.content import hash_paths, is_split

        hashed = hash_paths(flagged, algo=algo, gate="size_hit", chunk_size=chunk_size, split_bytes=split_bytes)
    hashed = materialise(hashed, "hashed")
    found = hashed.filter(F.col("content_hash").isNotNull()).join(exact_lookup(idx), "content_hash", "left")
    if split_bytes and "content" not in targets.columns:
        found = materialise(found, "found")
        large = is_split(split_bytes) & F.col("exact_path").isNotNull()
        digested = materialise(hash_paths(found.filter(large).drop("content_hash"), algo=algo, chunk_size=chunk_size), "digested")
        found = found.filter(~large).unionByName(digested)
    rest = hashed.filter(F.col("content_hash").isNull()).withColumn("exact_path", F.lit(None).cast("string"))
    return found.unionByName(rest)
