"""Driver-table fixtures: a ``files`` frame and an ``existing`` frame built from
``documents`` (the driver tables hold no file trees).

Rules (FIXTURES.md §2, §6) - every document becomes exactly one file:

* side: ``ref`` for even ``doc_id``, else ``target``;
* suffix by ``doc_id % 5``: ``.JPG .jpg .png .mov .heic``;
* ``doc_id % 50`` in (7, 8) -> name ``._doc_<id>.jpg``; in (11, 12) -> ``d<id>/.DS_Store``;
  in (13, 14) -> extra directory ``.Trash/``; otherwise ``doc_<id><suffix>``;
* rel_path = ``<source>/<lang>/...``; size = UTF-8 bytes of ``text``;
  mtime = 2024-01-01 00:00:00 UTC + doc_id minutes; content = ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_hash
from ..functions.paths import ext_of, name_of, parent_of, stem_of, suffix_of
from .filesystems import is_remote, mounted, write_file
from .tables import read_table, spread

# fixed values of the fixture layout
FIXTURE_SUFFIXES = (".JPG", ".jpg", ".png", ".mov", ".heic")
FIXTURE_EPOCH_SECONDS = 1704067200  # 2024-01-01 00:00:00 UTC


def documents_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The driver tables are one row group each (one scan task): spread the scan so
    # hashing and tokenising use every core; a no-op on a table with many splits.
    return files_from_documents(spread(read_table(spark, sf_dir, "documents")))


def files_from_documents(documents: DataFrame) -> DataFrame:
    """The ``files`` rows of any frame with documents' columns (also a streaming one)."""
    docs = documents.select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    m50 = i % 50
    m5 = i % 5
    sfx = F.element_at(F.array(*[F.lit(s) for s in FIXTURE_SUFFIXES]), (m5 + 1).cast("int"))
    base = F.concat_ws("/", F.col("source"), F.col("lang"))
    sid = i.cast("string")
    rel = (
        F.when(m50.isin(7, 8), F.concat(base, F.lit("/._doc_"), sid, F.lit(".jpg")))
        .when(m50.isin(11, 12), F.concat(base, F.lit("/d"), sid, F.lit("/.DS_Store")))
        .when(m50.isin(13, 14), F.concat(base, F.lit("/.Trash/doc_"), sid, sfx))
        .otherwise(F.concat(base, F.lit("/doc_"), sid, sfx))
    )
    files = docs.select(
        "doc_id",
        F.when(i % 2 == 0, F.lit("ref")).otherwise(F.lit("target")).alias("side"),
        rel.alias("rel_path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.timestamp_seconds(F.lit(FIXTURE_EPOCH_SECONDS) + i * 60).alias("mtime"),
        F.col("text").alias("content"),
    )
    return files.select(
        "doc_id",
        "side",
        F.col("rel_path").alias("path"),
        "rel_path",
        name_of("rel_path").alias("name"),
        ext_of(name_of("rel_path")).alias("ext"),
        "size",
        "mtime",
        "content",
    )


def existing_destinations(files: DataFrame, algo: str = "sha256") -> DataFrame:
    """Destination tree already present before a copy (FIXTURES.md §6).

    From the given (filtered target) rows: ``doc_id % 10 = 1`` -> same path, same
    content; ``% 10 = 3`` -> same path, different content; ``% 20 = 3`` -> also
    ``<stem>_1<suffix>`` taken; ``% 60 = 3`` -> also ``<stem>_3<suffix>`` taken.
    Schema: rel_path, size, content_hash.
    """
    i = F.col("doc_id")
    changed = F.concat(F.col("content"), F.lit("x"))
    same = files.filter(i % 10 == 1).select(
        "rel_path", "size", content_hash("content", algo).alias("content_hash")
    )
    differ = files.filter(i % 10 == 3).select(
        "rel_path", F.octet_length(changed).cast("bigint").alias("size"), content_hash(changed, algo).alias("content_hash")
    )

    def taken(k: int, cond):
        d = parent_of("rel_path")
        nm = F.concat(stem_of(name_of("rel_path")), F.lit(f"_{k}"), suffix_of(name_of("rel_path")))
        return files.filter(cond).select(
            F.when(d == "", nm).otherwise(F.concat(d, F.lit("/"), nm)).alias("rel_path"),
            F.octet_length(changed).cast("bigint").alias("size"),
            content_hash(changed, algo).alias("content_hash"),
        )

    return same.unionByName(differ).unionByName(taken(1, i % 20 == 3)).unionByName(taken(3, i % 60 == 3))


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write ``files`` (doc_id, rel_path, mtime, content) below ``root`` from the executors, ``doc_id % 50 = 17`` with a
    symbolic link ``link_<doc_id>.jpg`` beside it (where ``root`` is mounted); returns (path) of every written file."""

    def run(batches):
        import os

        import pyarrow as pa

        for b in batches:
            paths = [f"{root}/{r}" for r in b.column("rel_path").to_pylist()]
            for i, p, t, c in zip(b.column("doc_id").to_pylist(), paths, b.column("mtime").to_pylist(), b.column("content").to_pylist()):
                write_file(p, (c or "").encode(), t.timestamp())
                if i % 50 == 17 and not is_remote(p):
                    link = f"{os.path.dirname(mounted(p))}/link_{i}.jpg"
                    if not os.path.lexists(link):
                        os.symlink(mounted(p), link)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return files.select("doc_id", "rel_path", "mtime", "content").mapInArrow(run, "path string")
