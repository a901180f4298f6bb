"""Every stage of the corpus pipeline on its own input against a plain computation, and the whole run."""

import tempfile
import zlib
from collections import defaultdict

import corpus_pipeline
from conftest import SF0001
from llm_cases import docs, empty, rows, table_dir
from test_llm_documents import brute_fingerprint, brute_lines, brute_secrets, check_packing, token_ids

from twinsieve.llm import quality_qda
from twinsieve.llm.common import BATCH_BYTES, BATCH_CONF, Scratch, read


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_on_their_own_input(spark):
    d = read(spark, SF0001, "documents")
    stages = dict(corpus_pipeline.STAGES)
    folder = tempfile.mkdtemp(prefix="llm-pipe-")

    def step(name, df, n):
        stages[name](spark, df, SF0001).write.parquet(f"{folder}/{n}")
        return spark.read.parquet(f"{folder}/{n}")

    good = step("quality classifier", d, 0)
    model = quality_qda.train(d, read(spark, SF0001, "labels"))
    scores = {r["doc_id"]: r["out"] for r in quality_qda.score(d.select("doc_id", "text"), model).collect()}
    assert {i for i, _ in pairs(good)} == {i for i, s in scores.items() if s >= 0.3} and good.columns == d.columns

    lines = step("line dedup", good, 1)
    assert sorted(pairs(lines)) == sorted((i, t) for i, _, _, t in brute_lines(pairs(good)))
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    one = step("SimHash near-dedup", lines, 2)
    data = dict(pairs(lines))
    fps = {i: brute_fingerprint(t) for i, t in data.items()}
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {i for i, _ in pairs(one)} == {find(i) for i in fps}

    clean = step("secret scans", one, 3)
    before = dict(pairs(one))
    assert {i for i, _ in pairs(clean)} == set(before)
    for i, t in pairs(clean):
        assert not brute_secrets(t) and (t == before[i] or "[SECRET]" in t)
        if not brute_secrets(before[i]) and t != before[i]:
            raise AssertionError("a document without base secrets changed")

    pieces = stages["packing"](spark, clean, SF0001).collect()
    check_packing(pieces, token_ids(pairs(clean)))


def test_run_equals_stages_in_order(spark):
    got = corpus_pipeline.run(spark, SF0001).collect()
    per = defaultdict(int)
    for r in got:
        per[r["doc_id"]] += r["length"]
    assert got and all(r["doc_tokens"] == per[r["doc_id"]] for r in got)
    assert corpus_pipeline.ORACLE_SQL is None and zlib.crc32(b"") == 0


def test_stage_cases(spark):
    folder = table_dir(docs(spark))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for df in (docs(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, folder)
            assert name == "packing" or out.columns == df.columns
            n = out.count()
            assert df.count() or n == 0
    assert corpus_pipeline.run(spark, folder).count() > 0 and len(rows()) == 13


def test_batches_of_python_stages_are_bounded_in_bytes(spark):
    """10,000 rows, the bound by rows, are any number of bytes where texts are long."""
    texts = spark.range(3000, numPartitions=1).selectExpr("repeat(cast(id + 1000 as string), 2500) as text")  # 30 MB

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows]), "size": pa.array([b.nbytes])})

    kept = spark.conf.get(BATCH_CONF, None)
    try:
        spark.conf.unset(BATCH_CONF)
        Scratch(spark, "batches")
        got = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == 3000 and all(r["size"] < 2 * BATCH_BYTES for r in got)
        spark.conf.set(BATCH_CONF, "12345678")
        Scratch(spark, "batches")
        assert spark.conf.get(BATCH_CONF) == "12345678"  # the session's own bound stays
    finally:
        spark.conf.set(BATCH_CONF, kept) if kept else spark.conf.unset(BATCH_CONF)
