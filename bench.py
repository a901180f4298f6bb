"""Headline-query benchmark.

Runs the flagship classification and its main building blocks on
``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with ``local[$BENCH_CPUS]``
and prints ONE JSON line.  Each query is executed in full into Spark's
``noop`` sink (no driver collect).  Every headline query first runs once,
untimed, on a smaller scale factor (``$BENCH_WARMUP_DIR``, default sf0.01), so
JVM start-up, JIT compilation and whole-stage code generation of each plan
shape are not charged to the measured run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinsieve.plans.fixture_queries import all_queries  # noqa: E402
from twinsieve.session import build_session  # noqa: E402

HEADLINE = (
    "classify",
    "classify_complete",
    "classify_bytes_only",
    "fingerprint64",
    "fingerprint64_vectors",
    "best_perceptual_match",
    "hash_groups",
    "copy_plan",
    "run_stats",
)


# Full runs on real files, timed apart from the headline total.
APART = ("tree_run", "image_run")


def write_trees(spark, sf_dir: str, root: str) -> None:
    """The documents as files of a ref and a target tree, the vectors as images of another pair."""
    from pyspark.sql import functions as F

    from twinsieve.sources.images import write_vector_images

    def write(batches):
        import pyarrow as pa

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                folder = f"{root}/docs/{'ref' if d % 2 == 0 else 'target'}/{d % 97}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/doc_{d}.txt", "w", encoding="utf-8") as f:
                    f.write(t or "")
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")})

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(16)
    run(docs.mapInArrow(write, "doc_id long"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").repartition(16)
    for side, rest in (("ref", 0), ("target", 1)):
        run(write_vector_images(vectors.filter(F.col("vec_id") % 2 == rest), f"{root}/images/{side}"))


def run_apart(spark, sf_dir: str) -> dict:
    import tempfile

    from twinsieve.plans.dedupe import dedupe

    root, times = tempfile.mkdtemp(prefix="twinsieve-bench-"), {}
    write_trees(spark, sf_dir, root)
    for name, kind in zip(APART, ("docs", "images")):
        t0 = time.perf_counter()
        out = dedupe(spark, f"{root}/{kind}/ref", f"{root}/{kind}/target", f"{root}/{kind}/out", dry_run=False)
        out.stats.collect()
        times[name] = round(time.perf_counter() - t0, 3)
    return times


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = all_queries()
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.01")
    for name in HEADLINE:
        run(qs[name](spark, warm_dir))
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        run(qs[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    apart = run_apart(spark, sf_dir)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": int(cpus),
                "apart": apart,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
