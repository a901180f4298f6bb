"""Versioned tables of file facts that follow a tree by deltas.

A table holds one row a file (``path, size, mtime`` and the facts worked out from its
bytes).  Its folder holds

    generation-<version>-<id>/files   rows of files that were added or changed
    generation-<version>-<id>/gone    paths that were removed
    manifest/v<version>.json          the generations that make up a version, oldest first

A folder is written once and never changed.  A version exists from the moment its manifest is renamed into
place - a rename that fails where the name is taken, so of two writers one wins and the other is told -
and a reader keeps the version it opened whatever is committed after.  A run that dies before the rename
leaves a folder that no manifest names, and the next run starts from the version before.

:func:`refresh` compares a listing with the current version on ``(path, size, mtime)``: facts are worked out
for added and changed files only.  Reading merges the generations: a row counts unless a later generation names its
path, which is one join of narrow rows with the paths of the deltas (small beside the first generation, so
normally broadcast by measured size).  When more than ``max_generations`` have piled up, the merged rows are
written as one generation of the next version; :func:`vacuum` removes what no kept version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import FINGERPRINT_FIELDS, reference_fingerprint
from ..session import sized

#: Deltas (with the first generation) that a version reads before they are merged.
MAX_GENERATIONS = 8
KEY = ("path", "size", "mtime")


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class Folder:
    """The few file-system calls of a versioned table, on whatever file system Spark reads it by."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._p("").getFileSystem(self.conf)

    def _p(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        p = self._p(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._p(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> None:
        """Write ``text`` whole, then rename it into place where nothing stands yet."""
        tmp = self._p(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}.tmp")
        out = self.fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(kind, 1)
        how[0] = kind.NONE
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(tmp).toUri(), self.conf)
        try:
            files.rename(tmp, self._p(name), how)
        except Exception as e:
            self.fs.delete(tmp, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"{self.path}/{name} is there already") from e
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self._p(name), True)


@dataclass(frozen=True)
class Version:
    """One committed version: its generations never change, so neither do its rows."""

    folder: Folder
    number: int
    tree: dict
    generations: tuple[dict, ...]
    schema: str
    changed: int = 0
    gone: int = 0

    def _read(self, i: int, what: str, schema: str) -> DataFrame:
        return sized(self.folder.spark.read.schema(schema).parquet(f"{self.folder.path}/{self.generations[i]['folder']}/{what}"))

    def rows(self) -> DataFrame:
        """The rows of all files of this version, merged from its generations."""
        parts = [self._read(i, "files", self.schema) for i in range(len(self.generations))]
        touched = None
        for i in range(1, len(parts)):
            paths = parts[i].select("path")
            if self.generations[i]["gone"]:
                paths = paths.unionByName(self._read(i, "gone", "path string"))
            paths = paths.withColumn("_last", F.lit(i))
            touched = paths if touched is None else touched.unionByName(paths)
        if touched is None:
            return parts[0]
        every = parts[0].withColumn("_generation", F.lit(0))
        for i, p in enumerate(parts[1:], 1):
            every = every.unionByName(p.withColumn("_generation", F.lit(i)))
        last = touched.groupBy("path").agg(F.max("_last").alias("_last"))
        live = every.join(last, "path", "left").where(F.col("_last").isNull() | (F.col("_last") == F.col("_generation")))
        return live.drop("_last", "_generation").select(*parts[0].columns)


def versions(folder: Folder) -> list[int]:
    return [int(n[1:-5]) for n in folder.names("manifest") if n.startswith("v") and n.endswith(".json")]


def open_version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The newest version of the table at ``path`` (or version ``number``); None where there is none or it cannot be read."""
    folder = Folder(spark, path)
    there = versions(folder)
    if not there or (number is not None and number not in there):
        return None
    try:
        m = json.loads(folder.read(f"manifest/v{number or max(there):010d}.json"))
        return Version(folder, m["version"], m["tree"], tuple(m["generations"]), m["schema"], m["changed"], m["gone"])
    except (ValueError, KeyError):
        return None


def _commit(folder: Folder, number: int, tree: dict, generations: list[dict], schema: str, changed: int, gone: int, delta: str | None = None) -> Version:
    """``delta``: the generation whose files are new in this version (none when it only merges older ones)."""
    m = {"version": number, "tree": tree, "generations": generations, "schema": schema, "changed": changed, "gone": gone, "delta": delta}
    folder.commit(f"manifest/v{number:010d}.json", json.dumps(m, indent=1))
    return Version(folder, number, tree, tuple(generations), schema, changed, gone)


def _write(df: DataFrame, path: str) -> int:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


@dataclass
class Refreshed:
    version: Version
    reused: bool
    changed: int = field(default=0)
    gone: int = field(default=0)


def refresh(
    spark: SparkSession,
    files: DataFrame,
    path: str,
    facts: Callable[[DataFrame, DataFrame | None], DataFrame],
    *,
    tree_of: DataFrame | None = None,
    ref_path: str = "",
    options: str = "",
    rebuild: bool = False,
    verify: bool = False,
    max_generations: int = MAX_GENERATIONS,
    retry: str | None = None,
) -> Refreshed:
    """Bring the table at ``path`` to the state of ``files`` (path, size, mtime, ...).

    ``facts(files, todo)`` returns the rows (path, size, mtime, facts) of the files whose path is in ``todo`` (None: of all).
    A version whose tree fingerprint - root, options, number of files, bytes, newest time, of ``tree_of`` or else
    ``files`` - equals the present one is reused as it is; ``verify`` compares every file even then.  Other ``options``, another root or
    ``rebuild`` start anew.  Rows for which the SQL condition ``retry`` holds (failed reads) are worked out again.
    """
    folder = Folder(spark, path)
    row = reference_fingerprint(files if tree_of is None else tree_of, ref_path, options).withColumn("max_mtime", F.unix_micros("max_mtime")).first()
    tree = {f: row[f] for f in FINGERPRINT_FIELDS}
    there = versions(folder)
    number = max(there, default=0) + 1
    old = None if rebuild else open_version(spark, path)
    if old is not None and (old.tree["options"], old.tree["ref_path"]) != (options, ref_path):
        old = None
    if old is not None and old.tree == tree and not verify:
        return Refreshed(old, True)
    name = f"generation-{number:010d}-{uuid.uuid4().hex}"
    base = f"{folder.path}/{name}"
    if old is None:
        rows = facts(files, None)
        n = _write(rows, f"{base}/files")
        done = _commit(folder, number, tree, [{"folder": name, "files": n, "gone": 0}], _ddl(rows), n, 0, name)
        return Refreshed(done, False, n, 0)
    now, before = files.select(*KEY), old.rows()
    sound = before if retry is None else before.where(F.coalesce(~F.expr(retry), F.lit(True)))
    same = sound.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("mtime").alias("_m"))
    todo = now.join(same, (F.col("path") == F.col("_p")) & F.col("size").eqNullSafe(F.col("_s")) & F.col("mtime").eqNullSafe(F.col("_m")), "left_anti")
    todo.select("path").write.parquet(f"{base}/todo")  # compared once: facts may read it often
    todo = sized(spark.read.schema("path string").parquet(f"{base}/todo"))
    gone = _write(before.select("path").join(now.select("path"), "path", "left_anti"), f"{base}/gone")
    if not gone and todo.isEmpty():
        folder.remove(name)
        return Refreshed(_commit(folder, number, tree, list(old.generations), old.schema, 0, 0), False)
    changed = _write(facts(files, todo), f"{base}/files")
    generations = [*old.generations, {"folder": name, "files": changed, "gone": gone}]
    done = _commit(folder, number, tree, generations, old.schema, changed, gone, name)
    if len(generations) > max_generations:
        done = compact(done)
    return Refreshed(done, False, changed, gone)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def compact(version: Version) -> Version:
    """The same rows as one generation, committed as the next version."""
    number = version.number + 1
    name = f"generation-{number:010d}-{uuid.uuid4().hex}"
    n = _write(version.rows(), f"{version.folder.path}/{name}/files")
    return _commit(version.folder, number, version.tree, [{"folder": name, "files": n, "gone": 0}], version.schema, version.changed, version.gone)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove the folders that none of the last ``keep`` versions names, and older manifests; returns what went.

    Readers of those older versions must be done, and no refresh may run."""
    folder = Folder(spark, path)
    there = sorted(versions(folder))
    kept = there[-max(1, keep):] if there else []
    named = {g["folder"] for n in kept for g in open_version(spark, path, n).generations}
    gone = [n for n in folder.names() if n.startswith("generation-") and n not in named]
    for n in there:
        if n not in kept:
            folder.remove(f"manifest/v{n:010d}.json")
    for n in gone:
        folder.remove(n)
    return gone
