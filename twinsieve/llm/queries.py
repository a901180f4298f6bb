"""The ``opN_<name>`` queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.llm import (
    cap_filters,
    fim_swar,
    lexical_scan,
    line_runs,
    mixture_packing,
    nn_descent,
    pii_weak,
    prefix_counts,
    quality_qda,
    secret_cnn,
    simhash_pivot,
    spm_nbest,
    warc_zstd,
)
from twinsieve.llm.common import read


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_pivot.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", simhash_pivot.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_qda.train(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = quality_qda.score(docs, model)
    return out.select("doc_id", quality_qda.held_out(F.col("doc_id")).alias("held_out"), F.col("out").alias("score"),
                      F.when(F.col("out") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_spm_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best segmentations of every text: score, pieces, a digest of the ids and of the text decoded from them."""
    return spm_nbest.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), n=4, digest=True)


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).pieces()


def op5_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_zstd.archive_and_read(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 50 == 0)


def op9_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_weak.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[pii_weak.count_of("base", k).alias(f"n_{k}") for k in pii_weak.KINDS],
                      F.sha2(pii_weak.joined("base"), 256).alias("base_sha256"), pii_weak.joined("spans").alias("spans"))


def op10_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_cnn.scan(docs, secret_cnn.train(docs))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_scan.rank(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"), top=10)


def op12_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_counts.count(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def op13_fim_swar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim_swar.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim_swar.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {
    "op1_simhash_pivots": op1_simhash_pivots,
    "op2_quality_qda": op2_quality_qda,
    "op3_spm_nbest": op3_spm_nbest,
    "op4_mixture_packing": op4_mixture_packing,
    "op5_cap_filters": op5_cap_filters,
    "op6_warc_zstd": op6_warc_zstd,
    "op7_line_dedup": op7_line_dedup,
    "op8_nn_descent": op8_nn_descent,
    "op9_pii_weak": op9_pii_weak,
    "op10_secret_cnn": op10_secret_cnn,
    "op11_lexical_scan": op11_lexical_scan,
    "op12_prefix_counts": op12_prefix_counts,
    "op13_fim_swar": op13_fim_swar,
}
