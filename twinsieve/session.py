"""SparkSession helpers.

The library never creates its own session in library code paths; these
helpers exist for tests, the bench and command-line use.  The shared
checkpoint folder is always read from ``spark.checkpoint.dir``; a local
default is set only when the session has none (tests, bench).
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "twinsieve") -> SparkSession:
    master = master or os.environ.get("TWINSIEVE_MASTER", "local[*]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TWINSIEVE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``, else the
    context's checkpoint dir).  A local folder is created only when neither is set
    and the master is ``local`` (tests, bench); a cluster without one is an error.
    Also makes sure the executors can import this package."""
    current = spark.conf.get(CHECKPOINT_CONF, None)
    sc = spark.sparkContext
    if not current:
        current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            # A machine-local folder is not visible to the other executors and is
            # lost with its machine: refuse rather than checkpoint somewhere unsafe.
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the whole cluster")
        current = tempfile.mkdtemp(prefix="twinsieve-ckpt-")
    if not spark.conf.get(CHECKPOINT_CONF, None):
        spark.conf.set(CHECKPOINT_CONF, current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    ship_package(spark, current)
    return current


BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of the batches that Python stages get; by rows alone, 10,000 whole texts make one.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches of at most about ``BATCH_BYTES`` (a longer row alone) unless the session sets a bound itself: each is held by
    the executor's JVM, outside its heap, and by the worker, several times over."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession, folder: str) -> None:
    """Zip this package once per SparkContext and ``addPyFile`` it, so Python UDFs
    and ``mapInArrow``/``mapInPandas`` functions can import it on every executor."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import io
    import uuid
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, filenames in os.walk(pkg_dir):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for name in filenames:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    zf.write(full, os.path.relpath(full, root))
    target = f"{folder.rstrip('/')}/twinsieve-pkg-{uuid.uuid4().hex}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)


class _Scopes(threading.local):
    """The open scopes of a thread, each with the folders made in it."""

    def __init__(self):
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Scratch folders made inside are removed when the block ends: what it computed must be written by then."""
    _SCOPES.open.append([])
    try:
        yield
    finally:
        for path in _SCOPES.open.pop():
            remove_folder(spark, path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a scratch folder and read back: computed once, lineage cut, survives lost executors, and its size is known."""
    path = f"{scratch_folder(df.sparkSession, label)}/rows"
    df.write.parquet(path)
    return sized(df.sparkSession.read.schema(df.schema).parquet(path))


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a frame that :func:`materialise` gave."""
    files = df.inputFiles()
    if not files:
        return 0
    p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    return p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


# Times its files' bytes that a table with a distinct column hardly takes in memory: below that share of the threshold nothing is read.
MOST_PACKED = 100


def broadcast_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take in a broadcast's hash table: key and row (8 bytes a field and before them,
    strings on top, rounded up), and up to 64 bytes of the table for each.  One pass over the rows."""
    def extra(f) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = c.cast("string")
        elif not isinstance(f.dataType, (StringType, BinaryType)):
            return F.lit(0)
        return F.coalesce(F.octet_length(c) + 7, F.lit(0))

    fields = df.schema.fields
    row = F.lit(8 * (1 + len(fields))).cast("bigint")
    for f in fields:
        row = row + extra(f)
    return df.agg(F.sum(2 * row + 64).alias("n")).first()["n"] or 0


def fits_broadcast(df: DataFrame) -> bool:
    """Whether ``df``, read from written files, takes at most the session's broadcast threshold in memory."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    written = written_bytes(df)
    return written * MOST_PACKED <= limit or (written <= limit and broadcast_bytes(df) <= limit)


def sized(df: DataFrame) -> DataFrame:
    """``df``, read from written files, with its joins shuffled where it is too large in memory for a broadcast.

    Spark takes the files' bytes for the size: paths are packed there to a tenth of what their broadcast would take of the driver."""
    fits = fits_broadcast(df)
    out = df if fits else df.hint("merge")
    out._fits_broadcast = fits
    return out


def broadcast_if_small(df: DataFrame) -> DataFrame | None:
    """A :func:`materialise` d ``df`` marked for broadcast where it takes at most the session's broadcast threshold in memory; else None."""
    return F.broadcast(df) if df._fits_broadcast else None


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder, removed when the application (or the :func:`scope` it is made in) ends."""
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/twinsieve-{label}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark reads it by (the cluster's default file system for a bare path)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def remove_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpoint_dir(spark: SparkSession) -> str:
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        path = ensure_checkpoint_dir(spark)
    return path
