"""File-tree listing as Spark jobs.

Ways to scan a tree into the ``files`` schema (metadata only; content is read
later, on executors, only for the rows that need it).

* :func:`scan_tree` - a breadth-first walk, one Spark job per depth: the
  frontier directories are spread over all tasks, each task lists its
  directories in bounded pieces, and the level is written to a table in the
  shared checkpoint folder (the next frontier is read back from it) until no
  directory is left.  A subtree holding a third of the tree is thus split across
  tasks at every level.  On a mounted tree ``lstat`` - the costly call on a network filesystem -
  runs afterwards over the spread list of found files and its rows are
  written once, so every later use sees the same answer; a remote listing (any URI
  that ``pyarrow.fs`` opens, see :mod:`.filesystems`) brings sizes and times along.
  ``os.lstat`` semantics: directory links are not followed, symlinks and non-regular files are skipped,
  ignored directories are pruned, hidden, ``_``-prefixed and empty files are kept.
  A mounted tree must be mounted at the same path on the driver and every executor; a
  ``file:`` URI is such a path.  A root that cannot be listed is an error.
* :func:`twinsieve.sources.treesource.read_tree` - the same rows from a Spark data source,
  lazily, with filters pushed into the listing.
* :func:`scan_binary` - Spark's ``binaryFile`` source with only metadata
  columns selected (content is pruned from the read).  Works on any Hadoop
  filesystem, but drops names starting with ``.``/``_`` and empty files and
  follows links (see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ext_of, name_of, normalise_uri, relative_to
from ..session import remove_folder, scratch_folder
from .filesystems import Entry, is_remote, tree_of

LISTING_SCHEMA = "path string, size bigint, mtime timestamp, error string"
LEVEL_SCHEMA = "path string, is_dir boolean, size bigint, mtime timestamp, regular boolean"
# Tasks of a walk, for each core.
PARTITIONS_PER_CORE = 4
# Entries a listing task holds at a time.
PIECE = 10_000


def _as_files(listing: DataFrame, root: str, side: str | None) -> DataFrame:
    rel = relative_to("path", root)
    df = listing.select(
        *([F.lit(side).alias("side")] if side else []),
        "path",
        rel.alias("rel_path"),
        name_of("path").alias("name"),
        ext_of(name_of("path")).alias("ext"),
        "size",
        "mtime",
        *(["error"] if "error" in listing.columns else []),
    )
    return df


def _list_children(root: str, listed: bool):
    """mapInArrow: (dir) -> LEVEL_SCHEMA rows of every entry right below each directory, in bounded pieces."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_()]
        names = ["path", "is_dir", "size", "mtime", "regular"]
        tree, held = tree_of(root, listed), []

        def piece():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        for batch in batches:
            for d in batch.column("dir").to_pylist():
                for e in tree.children(d):
                    held.append((e.path, e.is_dir, e.size, e.mtime, e.regular))
                    if len(held) == PIECE:
                        yield piece()
                        held.clear()
        if held:
            yield piece()

    return run


def _stat_files(root: str, everything: bool):
    """mapInPandas: (path, is_dir) -> LISTING_SCHEMA rows; with ``everything`` links, directories
    and other non-regular entries stay, with no size."""

    def run(batches):
        import pandas as pd

        tree = tree_of(root)
        for pdf in batches:
            rows = [Entry(p, d) if d else tree.stat(Entry(p, d)) for p, d in zip(pdf["path"], pdf["is_dir"])]
            rows = [e for e in rows if everything or (e.regular and not e.is_dir)]
            yield pd.DataFrame(
                {
                    "path": pd.Series([e.path for e in rows], dtype=object),
                    "size": pd.Series([e.size for e in rows], dtype="Int64"),
                    "mtime": pd.Series([e.mtime for e in rows], dtype="datetime64[us, UTC]"),
                    "error": pd.Series([e.error for e in rows], dtype=object),
                }
            )

    return run


def walk_tree(spark: SparkSession, root: str, tasks: int | None = None, everything: bool = False, listed: bool = False) -> DataFrame:
    """LISTING_SCHEMA rows of every regular file below ``root`` (distributed BFS), written once.

    ``everything``: also links, directories and other entries (size NULL).
    ``listed``: a mounted tree through ``pyarrow.fs``, as a remote one (links are followed there)."""
    tree = tree_of(root, listed)
    tree.check()
    n = tasks or spark.sparkContext.defaultParallelism * PARTITIONS_PER_CORE
    levels, folder = scratch_folder(spark, "levels"), scratch_folder(spark, "listing")
    frontier, depth = spark.createDataFrame([(tree.root,)], "dir string"), 0
    while True:
        level = f"{levels}/depth={depth}"
        frontier.repartition(n).mapInArrow(_list_children(root, listed), LEVEL_SCHEMA).write.parquet(level)
        frontier, depth = spark.read.parquet(level).filter(F.col("is_dir")).select(F.col("path").alias("dir")), depth + 1
        if frontier.isEmpty():
            break
    found = spark.read.parquet(levels)
    if not everything:
        found = found.filter(~F.col("is_dir") & F.col("regular"))
    if tree.knows_sizes:
        out = found.select("path", "size", "mtime", F.lit(None).cast("string").alias("error"))
    else:
        out = found.select("path", "is_dir").repartition(n).mapInPandas(_stat_files(root, everything), LISTING_SCHEMA)
    out.write.parquet(f"{folder}/stat")
    remove_folder(spark, levels)
    return spark.read.schema(LISTING_SCHEMA).parquet(f"{folder}/stat")


def scan_tree(spark: SparkSession, root: str, side: str | None = None, partitions: int | None = None, everything: bool = False, listed: bool = False) -> DataFrame:
    """``files`` rows of a tree."""
    return _as_files(walk_tree(spark, root, partitions, everything, listed), tree_of(root, listed).root, side)


def scan_binary(spark: SparkSession, root: str, side: str | None = None) -> DataFrame:
    """``files`` rows via ``binaryFile`` metadata columns (content pruned from the scan)."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(normalise_uri("path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )
    return _as_files(listing, root.rstrip("/") if is_remote(root) else tree_of(root).root, side)
