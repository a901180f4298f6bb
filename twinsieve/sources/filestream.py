"""ST1 over files: a stream of the files that appear or change below a tree.

Two parts, joined by an offset log in a shared folder:

* :func:`discover` lists the tree as Spark jobs, compares the listing with the log on ``(path, size, mtime)`` and
  commits the files that are new or changed as one more version of the log (a versioned table,
  :mod:`twinsieve.plans.versions`): nothing of the size of the tree passes the driver, and a discovery that
  dies leaves no version.
* the ``filetree`` source as a stream reads the log: an offset is a version number, the batch between two offsets is
  the versions' added rows, one input partition a written file.  Versions never change, so a batch that is run
  again after a failure has the same rows, and a restarted query goes on where its checkpoint stands.

A file is delivered once for each state it was seen in; files that vanish are forgotten (and delivered again
if they come back).
"""

from __future__ import annotations

import json
import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from .filesystems import Entry, open_seekable, tree_of
from .treesource import SCHEMA, TreeSource

COLUMNS = ("path", "rel_path", "name", "ext", "size", "mtime", "error")
#: Versions whose paths the log keeps apart before it merges them.
LOG_GENERATIONS = 64


def discover(spark: SparkSession, root: str, log: str) -> int:
    """Commit what is new or changed below ``root`` to the log; returns the log's newest version."""
    from ..plans.versions import refresh
    from .filetree import scan_tree

    def rows(files: DataFrame, todo: DataFrame | None) -> DataFrame:
        files = files.select(*COLUMNS)
        return files if todo is None else files.join(todo, "path", "left_semi")

    # Every state counts, so every file is compared whatever the totals say.
    got = refresh(spark, scan_tree(spark, root), log, rows, ref_path=tree_of(root).root, verify=True, max_generations=LOG_GENERATIONS)
    return got.version.number


@dataclass
class LoggedFiles(D.InputPartition):
    """One written file of a version's added rows."""

    file: str

    def __init__(self, file: str):
        super().__init__(None)
        self.file = file


class TreeStreamReader(D.DataSourceStreamReader):
    """The log as a stream; runs beside the driver and in tasks, so it reads by ``pyarrow`` alone."""

    def __init__(self, options: dict):
        self.log = (options.get("log") or "").rstrip("/")
        if not self.log:
            raise ValueError("a stream of files needs option log: the folder of its offset log (see discover)")

    def _below(self, folder: str) -> list[Entry]:
        return [e for e in tree_of(folder).children(folder.removeprefix("file:") if folder.startswith("file:/") else folder) if not e.is_dir]

    def _versions(self) -> list[int]:
        names = [e.path.rpartition("/")[2] for e in self._below(f"{self.log}/manifest")]
        return [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": max(self._versions(), default=0)}

    def partitions(self, start: dict, end: dict) -> list[D.InputPartition]:
        out = []
        for v in sorted(v for v in self._versions() if start["version"] < v <= end["version"]):
            with open_seekable(f"{self.log}/manifest/v{v:010d}.json") as f:
                delta = json.loads(f.read().decode())["delta"]
            if delta:
                out += [LoggedFiles(e.path) for e in self._below(f"{self.log}/{delta}/files") if e.path.endswith(".parquet")]
        return out

    def read(self, partition: LoggedFiles):
        import pyarrow as pa
        import pyarrow.parquet as pq

        kinds = pa.schema([(c, pa.int64() if c == "size" else pa.timestamp("us", tz="UTC") if c == "mtime" else pa.string()) for c in COLUMNS])
        with open_seekable(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=list(COLUMNS), batch_size=10_000):
                t = pa.Table.from_batches([batch]).select(list(COLUMNS))
                t = t.set_column(5, "mtime", t["mtime"].cast(pa.timestamp("us"), safe=False).cast(pa.timestamp("us", tz="UTC")))
                yield from t.cast(kinds).combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        return


class TreeStreamSource(TreeSource):
    """``filetree``, both ways: a listing (``read``) and a stream of what appears (``readStream``)."""

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(dict(self.options))


def read_file_stream(spark: SparkSession, log: str) -> DataFrame:
    """The files that :func:`discover` commits to ``log``, as a stream of ``files`` rows."""
    from ..session import qualified

    spark.dataSource.register(TreeStreamSource)
    return spark.readStream.format("filetree").schema(SCHEMA).option("log", qualified(spark, log)).load()


class Follower(threading.Thread):
    """Runs :func:`discover` every ``seconds`` until stopped; a failure ends it and is kept in ``failed``."""

    def __init__(self, spark: SparkSession, root: str, log: str, seconds: float):
        super().__init__(daemon=True, name=f"discover {root}")
        self._args, self._seconds, self._halt, self.failed = (spark, root, log), seconds, threading.Event(), None

    def run(self) -> None:
        while not self._halt.is_set():
            try:
                discover(*self._args)
            except Exception as e:  # noqa: BLE001 - told to whoever asks; the stream itself goes on
                self.failed = e
                return
            self._halt.wait(self._seconds)

    def stop(self) -> None:
        self._halt.set()
        self.join()

