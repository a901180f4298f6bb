"""Fingerprint providers: ``DataFrame[path, ...] -> DataFrame[path, fp]``.

The classifier only needs this contract, so images (pHash), text (SimHash)
and vectors (median bits) share the same matching plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprints import simhash_table, with_median_bits

FingerprintProvider = Callable[[DataFrame], DataFrame]


def text_simhash(text_col: str = "content") -> FingerprintProvider:
    def provide(df: DataFrame) -> DataFrame:
        # No repartitioning here: the input is a scan (spread at the source when it
        # has too few splits) or the output of a shuffle, and asking an adaptive
        # plan for its partition count would run its shuffle stages twice.
        return simhash_table(df.select("path", text_col), "path", text_col)

    provide.__name__ = "text_simhash"
    return provide


def vector_median_bits(vec_col: str = "embedding") -> FingerprintProvider:
    def provide(df: DataFrame) -> DataFrame:
        return with_median_bits(df.select("path", vec_col), vec_col).select("path", "fp")

    provide.__name__ = "vector_median_bits"
    return provide


def column_fingerprint(fp_col: str = "fp") -> FingerprintProvider:
    """Fingerprint already present as a column (e.g. precomputed pHash)."""

    def provide(df: DataFrame) -> DataFrame:
        return df.select("path", F.col(fp_col).cast("bigint").alias("fp"))

    provide.__name__ = "column_fingerprint"
    return provide
