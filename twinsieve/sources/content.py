"""S2/P5 for real files: content hashes read on the executors, by path.

A metadata-only ``files`` frame goes through ``mapInArrow``: each task opens
its files and streams them in ``chunk_size`` pieces into ``hashlib``, so
memory per task is bounded by the chunk size, not the file size (Spark's
``binaryFile`` would load whole files and fails above its length limit).  A
read error becomes an ``error`` string on the row - the row becomes
``skipped`` instead of failing the task.  Only rows whose ``gate`` column is
true are read (the size semi-join of the exact pass).  Paths with a URI
scheme are opened through ``pyarrow.fs``, so any filesystem it supports works.

A digest of a whole file is sequential: one task reads it.  With ``split_bytes`` files above that size are
read in ranges by many tasks instead and get a *range key*, a tree of range digests: equal for equal bytes
(and sizes), but not the file's digest.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_CHUNK_SIZE
from ..session import materialise
from .filesystems import copy_file, is_remote, mounted, open_input, open_seekable

#: Range digests combined at a time: a file of 4096 x 4096 ranges never puts more into one row.
FAN_IN = 4096


def is_split(split_bytes: int | None) -> Column:
    """Whether a row's file is read in ranges."""
    return F.coalesce(F.col("size") > F.lit(split_bytes), F.lit(False)) if split_bytes else F.lit(False)


def hash_range(path: str, start: int, length: int, chunk_size: int = DEFAULT_CHUNK_SIZE) -> str:
    """SHA-256 of a byte range; a file that ends before the range does is an error."""
    h, left = hashlib.sha256(), length
    with open_seekable(path) as f:
        f.seek(start)
        while left:
            chunk = f.read(min(chunk_size, left))
            if not chunk:
                raise OSError(f"ends {left} bytes before its listed size")
            h.update(chunk)
            left -= len(chunk)
    return h.hexdigest()


def range_digests(files: DataFrame, split_bytes: int, chunk_size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """(path, part, digest, error) of every range of ``split_bytes`` of the files (path, size); one file's ranges go to many tasks."""
    parts = files.select("path", "size", F.explode(F.expr(f"sequence(0L, (size - 1) div {split_bytes}L)")).alias("part"))
    # A stated number of partitions: the rows are few bytes, each stands for a whole range to read.
    n = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), files.sparkSession.sparkContext.defaultParallelism)
    todo = parts.repartition(n, "path", "part").select(
        "path", "part", (F.col("part") * split_bytes).alias("start"),
        F.least(F.lit(split_bytes).cast("bigint"), F.col("size") - F.col("part") * split_bytes).alias("length"))

    def run(batches):
        for b in batches:
            digests, errors = [], []
            for p, at, n in zip(*(b.column(c).to_pylist() for c in ("path", "start", "length")), strict=True):
                try:
                    digests.append(hash_range(p, at, n, chunk_size))
                    errors.append(None)
                except Exception as ex:  # noqa: BLE001 - any read failure skips the file
                    digests.append(None)
                    errors.append(f"Failed to hash {p}: {ex}")
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), b.column("part"), pa.array(digests, pa.string()), pa.array(errors, pa.string())],
                names=["path", "part", "digest", "error"])

    return todo.mapInArrow(run, "path string, part bigint, digest string, error string")


def range_keys(files: DataFrame, split_bytes: int, chunk_size: int = DEFAULT_CHUNK_SIZE) -> DataFrame:
    """(path, range_key, range_error): the digests of a file's ranges combined, ``FAN_IN`` at a time, into one key.

    The key ends in the range size: keys of different settings never compare as equal."""
    def combined(df: DataFrame, *keys: str) -> DataFrame:
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"])
        return df.groupBy(*keys).agg(F.sha2(F.concat_ws("", ordered), 256).alias("digest"), F.min("error").alias("error"))

    leaves = range_digests(files, split_bytes, chunk_size).withColumn("above", F.expr(f"part div {FAN_IN}"))
    nodes = combined(leaves, "path", "above").withColumnRenamed("above", "part")
    key = F.when(F.col("error").isNull(), F.concat("digest", F.lit(f":{split_bytes}")))
    return combined(nodes, "path").select("path", key.alias("range_key"), F.col("error").alias("range_error"))


def hash_file(path: str, algo: str = "blake2b", chunk_size: int = DEFAULT_CHUNK_SIZE) -> str:
    h = hashlib.blake2b() if algo == "blake2b" else hashlib.sha256()
    with open_input(path) as f:
        while True:
            chunk = f.read(chunk_size)
            if not chunk:
                break
            h.update(chunk)
    return h.hexdigest()


def hash_paths(df: DataFrame, algo: str = "blake2b", gate: str | None = None, chunk_size: int = DEFAULT_CHUNK_SIZE,
               split_bytes: int | None = None) -> DataFrame:
    """Adds ``content_hash`` (and ``error``) to a frame with ``path``; gated rows only.

    With ``split_bytes`` (asks for ``size``) files above it are read in ranges by many tasks and get their range key; paths
    are then expected once each."""
    if split_bytes:
        rows = materialise(df, "to-hash")  # narrow rows, read by both branches
        ask = is_split(split_bytes) & (F.col(gate) if gate else F.lit(True))
        if "error" in df.columns:
            ask = ask & F.col("error").isNull()
        keys = range_keys(rows.filter(ask).select("path", "size"), split_bytes, chunk_size)
        large = rows.filter(ask).drop("error").join(keys, "path", "left")
        large = large.withColumnsRenamed({"range_key": "content_hash", "range_error": "error"})
        return hash_paths(rows.filter(~ask), algo, gate, chunk_size).unionByName(large)
    has_error = "error" in df.columns
    out_schema = T.StructType(
        [f for f in df.schema.fields if f.name != "error"]
        + [T.StructField("content_hash", T.StringType()), T.StructField("error", T.StringType())]
    )
    names = [f.name for f in out_schema.fields]

    def run(batches):
        for b in batches:
            paths = b.column("path").to_pylist()
            gates = b.column(gate).to_pylist() if gate else [True] * len(paths)
            prior = b.column("error").to_pylist() if has_error else [None] * len(paths)
            hashes, errors = [], []
            for p, g, e in zip(paths, gates, prior):
                if e is not None or not g or p is None:
                    hashes.append(None)
                    errors.append(e)
                    continue
                try:
                    hashes.append(hash_file(p, algo, chunk_size))
                    errors.append(None)
                except Exception as ex:  # noqa: BLE001 - any read failure skips the file
                    hashes.append(None)
                    errors.append(f"Failed to hash {p}: {ex}")
            cols = [b.column(n) for n in names[:-2]] + [pa.array(hashes, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, out_schema)


def copy_files(plan: DataFrame, out_root: str) -> DataFrame:
    """K3 for real trees: copy ``src`` to ``out_root/final_dst`` on the executors for
    rows planned ``write`` or ``rename``; returns (src, dst, error) per attempted row.

    Each file is copied under a unique temporary name next to its destination and
    moved into place (see :func:`.filesystems.copy_file`), so a task lost mid-copy never
    leaves a partial file under a final name; its retry simply copies again.  Source and
    destination may be mounted or remote.
    """
    out_root = out_root.rstrip("/") if is_remote(out_root) else mounted(out_root)
    schema = T.StructType(
        [T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("error", T.StringType())]
    )
    todo = plan.filter("op IN ('write', 'rename')").select("src", "final_dst")

    def run(batches):
        for b in batches:
            srcs, dsts, errs = [], [], []
            for s, d in zip(b.column("src").to_pylist(), b.column("final_dst").to_pylist()):
                dst = f"{out_root.rstrip('/')}/{d}"
                try:
                    copy_file(s, dst)
                    err = None
                except Exception as ex:  # noqa: BLE001 - the row becomes skipped
                    err = str(ex)
                srcs.append(s)
                dsts.append(dst)
                errs.append(err)
            yield pa.RecordBatch.from_arrays([pa.array(srcs), pa.array(dsts), pa.array(errs, pa.string())], names=["src", "dst", "error"])

    return todo.mapInArrow(run, schema)
