"""S1 as a Spark data source: ``spark.read.format("filetree").load(root)``.

    register(spark)
    spark.read.format("filetree").load("hdfs://nn/photos").where("ext in ('.jpg', '.png') and size > 0")

Rows are the regular files of a tree on any file system that :mod:`.filesystems` reaches:
``path, rel_path, name, ext, size, mtime, error``.  The listing rules are those of
:func:`twinsieve.sources.filetree.scan_tree` (nothing hidden is lost, links and ignored directories are not entered).

Planning lists directories breadth-first on the driver until ``planned`` (default 512) of them are
open, or all are listed; each input partition gets some of them, the files right below the
listed ones as their own.  A task walks its subtrees directory by directory and yields Arrow
batches, so memory is bounded by one batch (a remote directory: by its listing).  For trees in
which one subtree holds most files, :func:`twinsieve.sources.filetree.scan_tree` deals every level out anew.

Filters on ``name`` and ``ext`` are applied to an entry's name before the file is touched -
on a mounted tree that saves its ``lstat`` - and those on ``size`` and ``mtime`` after it; all are exact, so Spark
does not repeat them.  Needs ``spark.sql.python.filterPushdown.enabled``; :func:`register` turns it on
only where a session allows it, and ``option("pushdown", "false")`` reads without.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from .filesystems import Entry, tree_of

SCHEMA = "path string, rel_path string, name string, ext string, size bigint, mtime timestamp, error string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: Directories that planning opens before it hands subtrees to tasks.
PLANNED = 512
#: Rows of a batch.
PIECE = 10_000
_COMPARE = {D.EqualTo: operator.eq, D.EqualNullSafe: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge,
            D.LessThan: operator.lt, D.LessThanOrEqual: operator.le, D.In: lambda x, of: x in of,
            D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: lambda x, of: of in x}
#: Columns known from a name, and those known once the file was looked at.
OF_NAME, OF_FILE = ("path", "rel_path", "name", "ext"), ("size", "mtime", "error")


def ext_of_name(name: str) -> str:
    """Lower-cased suffix: the last dot part that is not the whole name and not empty."""
    stem, dot, last = name.rpartition(".")
    return f".{last}".lower() if dot and stem and last else ""


@dataclass(frozen=True)
class Condition:
    """One pushed filter: ``column compared with value``, or its negation; a null never passes."""

    column: str
    kind: type
    value: object
    negated: bool = False

    @classmethod
    def of(cls, f: D.Filter, negated: bool = False) -> Condition | None:
        if isinstance(f, D.Not):
            return None if negated else cls.of(f.child, True)
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in OF_NAME + OF_FILE:
            return None
        if isinstance(f, (D.IsNull, D.IsNotNull)):
            return cls(f.attribute[0], D.IsNull, None, negated != isinstance(f, D.IsNotNull))
        if type(f) not in _COMPARE or (negated and isinstance(f, D.EqualNullSafe)):
            return None
        value = tuple(f.value) if isinstance(f, D.In) else f.value
        if value is None or (isinstance(value, tuple) and None in value):
            return None
        return cls(f.attribute[0], type(f), value, negated)

    def holds(self, row: dict) -> bool:
        x = row[self.column]
        if self.kind is D.IsNull:
            return (x is None) != self.negated
        return x is not None and _COMPARE[self.kind](x, self.value) != self.negated


@dataclass
class Directories(D.InputPartition):
    """Directories to walk, and listed ones of which only the files are read."""

    deep: tuple[str, ...]
    flat: tuple[str, ...]

    def __init__(self, deep, flat):
        super().__init__(None)
        self.deep, self.flat = tuple(deep), tuple(flat)


class TreeReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path")
        if not self.root:
            raise ValueError("filetree needs the root of a tree: load(root)")
        self.listed = options.get("listing", "").lower() == "arrow"
        self.planned = max(1, int(options.get("planned", PLANNED)))
        self.conditions: list[Condition] = []

    def tree(self):
        return tree_of(self.root, self.listed)

    def partitions(self) -> list[D.InputPartition]:
        tree = self.tree()
        tree.check()
        open_, listed = [tree.root], []
        while open_ and len(open_) < self.planned:  # a level at a time
            listed, open_ = listed + open_, [e.path for d in open_ for e in tree.children(d) if e.is_dir]
        n = max(1, min(self.planned, len(open_) + len(listed)))
        return [p for i in range(n) if (p := Directories(open_[i::n], listed[i::n])).deep or p.flat] or [Directories((), (tree.root,))]

    def rows(self, tree, entries: Iterator[Entry]) -> Iterator[tuple]:
        by_name = [c for c in self.conditions if c.column in OF_NAME]
        by_file = [c for c in self.conditions if c.column in OF_FILE]
        for e in entries:
            name = e.path.rpartition("/")[2]
            row = {"path": e.path, "rel_path": e.path[len(tree.root.rstrip("/")) + 1 :], "name": name, "ext": ext_of_name(name)}
            if not all(c.holds(row) for c in by_name):
                continue
            seen = tree.stat(e)
            if not seen.regular:
                continue
            row |= {"size": seen.size, "mtime": seen.mtime, "error": seen.error}
            if all(c.holds(row) for c in by_file):
                yield tuple(row.values())

    def files(self, tree, partition: Directories) -> Iterator[Entry]:
        for d in partition.flat:
            yield from (e for e in tree.children(d) if not e.is_dir)
        todo = list(partition.deep)
        while todo:
            for e in tree.children(todo.pop()):
                if e.is_dir:
                    todo.append(e.path)
                else:
                    yield e

    def read(self, partition: Directories):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("rel_path", pa.string()), ("name", pa.string()), ("ext", pa.string()),
                            ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC")), ("error", pa.string())])
        tree, held = self.tree(), []
        for row in self.rows(tree, self.files(tree, partition)):
            held.append(row)
            if len(held) == PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class FilteringTreeReader(TreeReader):
    def pushFilters(self, filters):
        for f in filters:
            c = Condition.of(f)
            if c is None:
                yield f
            else:
                self.conditions.append(c)


class TreeSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        plain = str(self.options.get("pushdown", "true")).lower() == "false"
        return (TreeReader if plain else FilteringTreeReader)(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``filetree`` known to the session, with filter push-down."""
    spark.dataSource.register(TreeSource)
    spark.conf.set(PUSHDOWN, "true")


def read_tree(spark: SparkSession, root: str, side: str | None = None, **options) -> DataFrame:
    """``files`` rows of the tree at ``root``, lazily listed; filters on them reach the listing."""
    register(spark)
    reader = spark.read.format("filetree")
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(root)
    if side is None:
        return df
    from pyspark.sql import functions as F

    return df.select(F.lit(side).alias("side"), "*")
