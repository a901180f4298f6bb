"""Corpus pipeline: quality classifier, line de-duplication, SimHash near-duplicates, secret scan, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents its
predecessor kept and returns a DataFrame; :func:`run` writes each result as
Parquet in the shared folder and rereads it as the next stage's input.  All
stages but the last return the columns of ``documents`` (``n_chars`` follows a
changed text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import line_runs, mixture_packing, quality_qda, secret_cnn, simhash_pivot
from twinsieve.llm.common import Scratch, read


def _like(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` of the text as it is now."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more)."""
    return quality_qda.keep_good(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier document holds."""
    return _like(line_runs.drop_repeated_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash: the one with the smallest id."""
    return simhash_pivot.keep_representatives(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark."""
    return _like(secret_cnn.redact(docs, secret_cnn.train(docs)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return mixture_packing.pack(docs).pieces()


STAGES: list[tuple[str, Callable]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("packing", packing),
]

# Learned models, fingerprints and tokenizer ids are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, path = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = scratch.save_replacing(stage(spark, docs, sf_dir), name.replace(" ", "-"), path)
    return STAGES[-1][1](spark, docs, sf_dir)
