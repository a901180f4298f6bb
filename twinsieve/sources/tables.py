"""Reading the driver's Parquet tables.

The scans are plain ``spark.read.parquet`` so Catalyst prunes columns and
pushes filters into the reader.  :func:`spread` exists because a table written
as one row group is read by one task: CPU-heavy per-row work (hashing,
fingerprints) would then run on one core.  It rebalances only when the scan
yields fewer partitions than the cluster has cores - on a large table with
many splits it is a no-op, so no full shuffle is added at scale.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cluster's cores when it has fewer partitions.

    Apply it to a scan (or narrow transformations of one): there the partition
    count is file-split planning.  On a plan containing a shuffle, AQE would
    execute the shuffle stages just to report the count.
    """
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want)
