"""Sinks: results CSV (K1), results Parquet, accepted-content table (K3).

The CSV matches a ``csv.writer`` file: a header of the six columns, fields
quoted only when needed, quotes doubled, empty strings written bare.  Row
order is unspecified (as in the tool we mirror, which writes in completion
order).  Each task writes its own part file, so nothing passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RESULT_COLUMNS

RESULT_SCHEMA = ", ".join(f"{c} string" for c in RESULT_COLUMNS)


def write_results_csv(results: DataFrame, path: str) -> None:
    (
        results.select(*RESULT_COLUMNS)
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("encoding", "UTF-8")
        .csv(path)
    )


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    df = (
        spark.read.schema(RESULT_SCHEMA)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )
    return df.na.fill("", list(RESULT_COLUMNS))


def write_results_parquet(results: DataFrame, path: str) -> None:
    results.select(*RESULT_COLUMNS).write.mode("overwrite").parquet(path)


def write_accepted(rows: DataFrame, plan: DataFrame, path: str) -> None:
    """K3: selected rows under their final relative destination, content and source mtime.

    Rows planned ``already_present`` are not written.  Never touches the input trees.
    """
    p = plan.filter(F.col("op").isin("write", "rename")).select(F.col("src").alias("path"), "final_dst")
    cols = [c for c in ("content", "mtime", "size") if c in rows.columns]
    rows.join(p, "path").select(F.col("final_dst").alias("rel_path"), F.col("path").alias("src"), *cols).write.mode(
        "overwrite"
    ).parquet(path)
