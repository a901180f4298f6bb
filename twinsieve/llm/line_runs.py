"""Line de-duplication over levelled sorted runs of line hashes.

The documents are taken in batches of rising ``doc_id``.  The line hashes seen
so far live in *runs*: bucketed, sorted tables in the shared folder, each key in
exactly one run.  A batch reduces its lines to distinct keys, merge-joins them
with every run (bucketed and sorted on both sides of the sort-merge join, the
run is never shuffled again), drops what the runs already hold and writes its
own new keys as a run of level 0.  When a level holds ``fan_in`` runs they are
compacted into one run of the next level, so a batch meets ``O(log batches)``
runs.

Because batches rise in ``doc_id``, a key found in an older run belongs to a
smaller document, and a new key belongs to the smallest document of the batch
that holds it: the outcome equals a global "keep the smallest document".

Defined results: null or empty text is one empty line; documents without a
``doc_id`` are passed through unchanged and hold no key; rows that repeat a
``doc_id`` count as one document (all its rows keep or lose a line together);
keys below ``min_chars`` code points never leave; other columns are carried
along untouched, whatever their names (outputs overwrite columns of the same
name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm.common import Scratch, ascii_lower, field, packed, unpacked

STRIP = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIP)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    """A 128-bit key hash as two independent 64-bit words."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LeveledRuns:
    """The runs of seen keys, by level; every run is bucketed and sorted by (h1, h2)."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int, fan_in: int):
        self.spark, self.scratch, self.buckets, self.fan_in = spark, scratch, buckets, fan_in
        self.levels: list[list[str]] = []

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, df: DataFrame) -> str:
        path = self.scratch.folder("run")
        name = "line_run_" + path.rsplit("/", 2)[-2].rsplit("-", 1)[-1] + "_" + path.rsplit("/", 1)[-1][:3]
        (df.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2").write
           .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
           .option("path", path).format("parquet").saveAsTable(name))
        return name

    def add(self, keys: DataFrame) -> None:
        new, level = self._write(keys), 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fan_in:
                return
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for t in full[1:]:
                merged = merged.unionByName(self.spark.table(t))
            new, level = self._write(merged), level + 1
            for t in full:
                self._forget(t)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        for level in self.levels:
            for t in level:
                self._forget(t)
        self.levels = []


def drop_repeated_lines(
    docs: DataFrame,
    min_chars: int = 10,
    batches: int = 4,
    fan_in: int = 2,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept lines, plus ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    known = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where("d is not null")
    cuts = sorted(set(known.approxQuantile("d", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    batch = sum((F.when(F.col("d") > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    narrow = (
        known.select("d", F.xxhash64(F.coalesce("t", F.lit(""))).alias("th"), "t")  # before the lines part: once a text, not once a line
        .select("d", "th", F.posexplode(_lines(F.col("t"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("d", "th", "pos", *_hashes(F.col("key")), batch.alias("b"))
    )
    lines = scratch.save(narrow, "lines", partition_by="b")
    runs = LeveledRuns(spark, scratch, int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in)
    decided = []
    for b in range(len(cuts) + 1):
        mine = lines.where(F.col("b") == b).groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last"))
        seen = F.lit(False)
        for i, run in enumerate(runs.tables()):
            mine = mine.join(run.select("h1", "h2", F.lit(True).alias(f"r{i}")), ["h1", "h2"], "left")
            seen = seen | F.coalesce(F.col(f"r{i}"), F.lit(False))
        mine = scratch.save(mine.select("h1", "h2", "first", "last", seen.alias("seen")), "batch")
        if b < len(cuts):
            runs.add(mine.where(~F.col("seen")).select("h1", "h2"))
        # ``keep``: the document that keeps the key; none of this batch when an older run holds it.
        decided.append(mine.where(F.col("seen") | (F.col("first") < F.col("last")))
                       .select(F.lit(b).alias("b"), "h1", "h2", F.when(~F.col("seen"), F.col("first")).alias("keep")))
    runs.close()
    both = decided[0]
    for x in decided[1:]:
        both = both.unionByName(x)
    # Both sides are shuffled for this join alone, so AQE splits a line that is very common.
    hit = lines.join(scratch.save(both, "decided"), ["b", "h1", "h2"]).where(F.col("keep").isNull() | (F.col("d") > F.col("keep")))
    gone = hit.groupBy("d", "th").agg(F.collect_set("pos").alias("gone"))
    text = field(text_col)
    out = (
        packed(docs).withColumn("d", field(id_col)).withColumn("th", F.xxhash64(F.coalesce(text, F.lit(""))))
        .join(gone, ["d", "th"], "left")
        .withColumn("lines", _lines(text))
    )
    kept = F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(
        # By hash, so that a text of very many lines takes time in proportion.
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i)), "\n"))
    return unpacked(out, docs.columns, {
        text_col: kept,
        "n_lines": F.size("lines").cast("long"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    })
