"""Shared helpers of the training-data operators: table reading and shared-folder scratch."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.session import BATCH_BYTES, BATCH_CONF, bound_batches, checkpoint_dir, ensure_checkpoint_dir  # noqa: F401

WORD = "[0-9A-Za-zÀ-ɏ]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Memo(dict):
    """Remembers ``compute`` of keys of up to ``longest`` characters in two generations of at most ``size`` entries:
    the memory is bounded in bytes, recurring keys stay."""

    def __init__(self, compute, size: int, longest: int = 48):
        self.compute, self.size, self.longest, self.old = compute, size, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        got = self.old.get(key)
        if got is None:
            got = self.compute(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got

    def many(self, keys: list, compute) -> list:
        """The values of distinct keys; ``compute`` gives those of a list of keys that are not remembered."""
        out = list(map(self.get, keys))
        older = [i for i, v in enumerate(out) if v is None]
        for i in older:
            out[i] = self.old.get(keys[i])
        new = [i for i in older if out[i] is None]
        for i, v in zip(new, compute([keys[i] for i in new])):
            out[i] = v
        kept = [i for i in older if len(keys[i]) <= self.longest][: self.size]
        if self and len(self) + len(kept) > self.size:
            self.old = dict(self)
            self.clear()
        self.update([(keys[i], out[i]) for i in kept])
        return out


def word_borders(pieces, mark: str) -> re.Pattern:
    """Finds the chunks that no piece crosses: before a ``mark`` that follows another character, around a line end that is
    in no piece, and between a letter or digit and punctuation that no piece has after one."""
    beside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    ends = "".join(c for c in ".,;:!?" if not any(x[1] == c and re.match(WORD, x) for x in beside))
    line = "\n" if not any("\n" in p for p in pieces) else ""
    more = f"[^{mark}{line}{ends}]*"
    tail = f"(?:(?<!{WORD})[{ends}]{more})*" if ends else ""
    return re.compile(f"{mark}*[^{mark}{line}]{more}{tail}|{mark}+" + f"|{line}" * bool(line))


class Scratch:
    """One folder below ``spark.checkpoint.dir`` for the written tables of one run.

    The folder is registered with Hadoop's ``deleteOnExit``: the returned (lazy)
    DataFrames may read it for as long as the application lives.
    """

    def __init__(self, spark: SparkSession, label: str):
        ensure_checkpoint_dir(spark)
        bound_batches(spark)
        self.spark = spark
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        self._fs, self._jvm, self._n = fs, jvm, 0

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and read it back: cuts lineage, survives lost executors."""
        path = self.folder(name)
        w = df.write.partitionBy(partition_by) if partition_by else df.write
        w.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df_path: str) -> None:
        """Remove a table this run no longer reads."""
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(df_path), True)

    def save_replacing(self, df: DataFrame, name: str, old: str | None) -> tuple[DataFrame, str]:
        """As :meth:`save`, then drop ``old``: an iteration keeps one copy of its state on disk."""
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if old:
            self.drop(old)
            # Shuffle files go when the driver's JVM collects the plans that made them: a long
            # iteration asks for that, so that it keeps about one round on disk.
            gc.collect()
            self._jvm.System.gc()
        return out, path


def ascii_lower(col):
    """Lower-case A-Z only (``lower`` would fold other letters too)."""
    return F.translate(col, UPPER, UPPER.lower())


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def packed(df: DataFrame, name: str = "__row") -> DataFrame:
    """The whole row as one struct, so that work columns never clash with the input's names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def field(name: str, row: str = "__row"):
    return F.col(row).getField(name)


def unpacked(df: DataFrame, columns: list[str], new: dict, row: str = "__row") -> DataFrame:
    """The input's ``columns`` again, those named in ``new`` replaced, the rest of ``new`` appended."""
    keep = [(new.pop(c) if c in new else field(c, row)).alias(c) for c in columns]
    return df.select(*keep, *[v.alias(k) for k, v in new.items()])


def by_position(df: DataFrame) -> DataFrame:
    """Columns named c0, c1, ...: Python stages address them by position, whatever the input calls them
    (a name with a dot cannot be passed to them)."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])
