"""ST1: incremental classification with Structured Streaming.

New target rows arrive on a stream; each micro-batch is classified against a
*static*, persisted ref index (read once from Parquet, so batches never
recompute ref hashes).  ``foreachBatch`` runs the ordinary batch classifier
(the near pass ends in an aggregation, which append mode rejects without a
watermark).  Each batch overwrites its own ``batch_id=<n>`` folder, so a
replay after an executor or driver failure is idempotent, and the checkpoint
in the shared folder lets a restarted query resume without adding rows.
Targets may be rows (:func:`start_classify_stream`) or the files of a tree
(:func:`start_tree_stream`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT_THRESHOLD
from ..functions.providers import FingerprintProvider, text_simhash
from ..operators.classify import classify
from ..operators.filters import prepare_side
from ..plans.index import ReferenceIndex, build_or_load
from ..session import is_folder, scope
from ..sources.filestream import Follower, discover, read_file_stream
from ..sources.fixtures import documents_files, files_from_documents
from ..sources.tables import read_table, table_path

#: Micro-batches of the fixture stream, at most.
FIXTURE_BATCHES = 4


def start_classify_stream(
    targets_stream: DataFrame,
    to_targets: Callable[[DataFrame], DataFrame],
    exact_index: DataFrame,
    fp_index: DataFrame | None,
    out_path: str,
    checkpoint: str,
    *,
    fingerprint: FingerprintProvider | None = None,
    threshold: int = DEFAULT_THRESHOLD,
    match_mode: str = "lsh",
    algo: str = "sha256",
    out_dir: str = "out",
    available_now: bool = True,
    seconds: float = 10,
    split_bytes: int | None = None,
) -> StreamingQuery:
    """Start the stream; ``to_targets`` turns a micro-batch into filtered target ``files`` rows; ``split_bytes`` as the index was made with."""

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        with scope(batch.sparkSession):  # what the batch writes on the way goes when it ends
            res = classify(
                None,
                to_targets(batch),
                fingerprint=fingerprint,
                threshold=threshold,
                match_mode=match_mode,
                algo=algo,
                exact_index=exact_index,
                fp_index=fp_index,
                out_dir=out_dir,
                split_bytes=split_bytes,
            )
            res.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    writer = targets_stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def start_tree_stream(
    spark: SparkSession,
    root: str,
    log: str,
    index: ReferenceIndex,
    out_path: str,
    checkpoint: str,
    *,
    extensions=None,
    every: float | None = None,
    **options,
) -> StreamingQuery:
    """Classify the files that appear below ``root``, each state of a file once.

    One pass over what is there now, or with ``every`` a discovery every so many seconds for as long as the
    query runs (``query.follower``; stop both).  ``log`` is the stream's offset log (see :mod:`..sources.filestream`);
    ``options`` are those of :func:`start_classify_stream`."""
    follower = None
    if every is None:
        discover(spark, root, log)
    else:
        follower = Follower(spark, root, log, every)
        follower.start()
    query = start_classify_stream(
        read_file_stream(spark, log), lambda batch: prepare_side(batch, extensions), index.exact, index.near, out_path, checkpoint,
        available_now=every is None, **options,
    )
    query.follower = follower
    return query


def read_stream_results(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(out_path).drop("batch_id")


def classify_documents_stream(spark: SparkSession, sf_dir: str, scratch: str, *, out_dir: str = "out") -> DataFrame:
    """The fixture stream: ``documents`` rows arrive as a file stream, targets are
    classified against the persisted index of the ref side."""
    files = documents_files(spark, sf_dir)
    ref = prepare_side(files.filter(F.col("side") == "ref"))
    fp = text_simhash()
    idx = build_or_load(spark, ref, f"{scratch}/index", ref_path="ref", fingerprint=fp)
    docs = read_table(spark, sf_dir, "documents")
    # Every batch reads the index: their number must not follow the number of files.
    reader = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", max(1, -(-len(docs.inputFiles()) // FIXTURE_BATCHES)))
    table = table_path(sf_dir, "documents")
    if is_folder(spark, table):  # a folder of part files is streamed itself; a single file from the folder that holds it
        stream = reader.parquet(table)
    else:
        stream = reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)

    def to_targets(batch: DataFrame) -> DataFrame:
        f = files_from_documents(batch)
        return prepare_side(f.filter(F.col("side") == "target"))

    q = start_classify_stream(
        stream, to_targets, idx.exact, idx.near, f"{scratch}/results", f"{scratch}/checkpoint", fingerprint=fp, out_dir=out_dir
    )
    q.awaitTermination()
    return read_stream_results(spark, f"{scratch}/results")
