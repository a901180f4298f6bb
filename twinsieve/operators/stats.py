"""Global aggregates: tree fingerprint (A5), run stats (A6/R9), index stats (A7), P13.

Each is one aggregation with partial combine: a single row comes out, nothing
row-sized reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import STATS_COLUMNS

FINGERPRINT_FIELDS = ("ref_path", "file_count", "total_bytes", "max_mtime", "options")


def reference_fingerprint(ref: DataFrame, ref_path: str, options: str = "") -> DataFrame:
    """A5: (ref_path, file_count, total_bytes, max_mtime, options).

    Unreadable files (NULL size/mtime) add to the count only.  An empty tree gives
    0 bytes and the epoch as max_mtime.  ``options`` records the settings that
    change the index (extension filter, hash algorithm, fingerprint kind, pixel
    limit) so an index built under other settings is never reused.
    """
    return ref.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.coalesce(F.max("mtime"), F.timestamp_seconds(F.lit(0))).alias("max_mtime"),
    ).select(
        F.lit(ref_path).alias("ref_path"),
        "file_count",
        "total_bytes",
        "max_mtime",
        F.lit(options).alias("options"),
    )


def fingerprints_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``matches`` - true iff both one-row fingerprints agree on every field.

    The two rows are unioned and compared as one struct, so no join is needed.
    """
    both = a.select(*FINGERPRINT_FIELDS).unionByName(b.select(*FINGERPRINT_FIELDS))
    fields = F.struct(*FINGERPRINT_FIELDS)
    return both.agg(
        ((F.count(F.lit(1)) == 2) & (F.count_distinct(fields) == 1)).alias("matches")
    )


def _stats() -> list[Column]:
    a = F.col("action")
    return [
        F.count(F.lit(1)).alias(STATS_COLUMNS[0]),
        F.count_if(a == "copied").alias(STATS_COLUMNS[1]),
        F.count_if(a == "exact_dup").alias(STATS_COLUMNS[2]),
        F.count_if(a == "phash_dup").alias(STATS_COLUMNS[3]),
        F.count_if(a == "skipped").alias(STATS_COLUMNS[4]),
    ]


def run_stats(results: DataFrame) -> DataFrame:
    """Total scanned and the count per action, from the results table."""
    return results.agg(*_stats())


def observe_stats(results: DataFrame) -> tuple[Observation, DataFrame]:
    """A6 as metrics of whatever job writes the returned frame: no second pass over the results.

    Write it as it is: in a job's last stage every partition counts once, tasks that are run again included."""
    observed = Observation()
    return observed, results.observe(observed, *_stats())


def observed_stats(spark: SparkSession, observed: Observation) -> DataFrame:
    """The one row of :func:`run_stats` from a written :func:`observe_stats` frame."""
    got = observed.get
    return spark.createDataFrame([tuple(int(got[c]) for c in STATS_COLUMNS)], ", ".join(f"{c} bigint" for c in STATS_COLUMNS))


def index_stats(ref: DataFrame, exact_index: DataFrame, fp_index: DataFrame | None) -> DataFrame:
    """Files in the ref (unreadable ones too), size buckets, unique fingerprints, indexed images."""
    parts = [
        _metric(ref, "total_files", F.count(F.lit(1))),
        _metric(exact_index, "size_buckets", F.count_distinct("size")),
    ]
    if fp_index is not None:
        parts.append(_metric(fp_index, "unique_phashes", F.count(F.lit(1))))
        parts.append(_metric(fp_index, "indexed_images", F.sum("n_files")))
    return _pivot_metrics(parts, ("total_files", "size_buckets", "unique_phashes", "indexed_images"))


def _metric(df: DataFrame, name: str, agg) -> DataFrame:
    return df.agg(agg.cast("bigint").alias("v")).select(F.lit(name).alias("k"), "v")


def _pivot_metrics(parts: list[DataFrame], names) -> DataFrame:
    """Union of (k, v) one-row frames -> one row with a column per name (0 when absent)."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.coalesce(F.max(F.when(F.col("k") == n, F.col("v"))), F.lit(0)).cast("bigint").alias(n) for n in names])
