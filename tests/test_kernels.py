"""Scalar kernels against plain Python: paths, extension lists, bit helpers, hashes."""

import hashlib
import random
import re
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from twinsieve.functions import fingerprints as FP
from twinsieve.functions.hashing import blake2b_hex, content_hash
from twinsieve.functions.paths import ext_of, name_of, parent_of, stem_of, suffix_of
from twinsieve.operators.filters import in_ignored_dir, is_ignored_name, normalise_extensions

NAMES = ["a.JPG", "foo.tar.GZ", ".jpg", "a.", "..jpg", "noext", "x.y.z", "_u.png", ".hidden.jpg", "a b#é.Jpeg"]


def test_suffix_stem_ext_match_pathlib(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    rows = df.select("name", suffix_of("name").alias("s"), stem_of("name").alias("t"), ext_of("name").alias("e")).collect()
    for r in rows:
        p = PurePosixPath(r["name"])
        assert r["s"] == p.suffix, r
        assert r["t"] + r["s"] == r["name"]
        assert r["e"] == p.suffix.lower()


def test_name_and_parent(spark):
    df = spark.createDataFrame([("a/b/c.jpg",), ("c.jpg",)], "p string")
    rows = df.select(name_of("p").alias("n"), parent_of("p").alias("d")).collect()
    assert [(r.n, r.d) for r in rows] == [("c.jpg", "a/b"), ("c.jpg", "")]


def test_ignored_names_and_dirs(spark):
    cases = [
        ("x/.DS_Store", True), ("x/._a.jpg", True), ("x/.x.jpg", False), ("x/_x.jpg", False),
        (".Trash/q.jpg", True), ("a/.Spotlight-V100/b/c", True), ("a/.fseventsd/z", True),
        ("a/.Trash", False), ("a/my.Trash/x", False), ("_dir/in.jpg", False),
    ]
    df = spark.createDataFrame([(p,) for p, _ in cases], "rel_path string").withColumn("name", name_of("rel_path"))
    got = df.select((is_ignored_name("name") | in_ignored_dir("rel_path")).alias("ign")).collect()
    assert [r.ign for r in got] == [e for _, e in cases]


def test_normalise_extensions():
    assert normalise_extensions(".jpg, .png") == (".jpg", ".png")
    assert normalise_extensions("JPG,png,") == (".jpg", ".png")
    assert normalise_extensions(" , ") is None
    assert normalise_extensions(None) is None


def test_chunks_hamming_against_python(spark):
    rnd = random.Random(7)
    vals = [rnd.getrandbits(64) for _ in range(50)] + [0, (1 << 64) - 1, 1 << 63]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in vals]
    pairs = [(a, b) for a, b in zip(signed, reversed(signed))]
    df = spark.createDataFrame(pairs, "a long, b long")
    rows = df.select("a", "b", *FP.chunk_columns("a"), FP.hamming("a", "b").alias("d")).collect()
    for r in rows:
        ua, ub = r.a & ((1 << 64) - 1), r.b & ((1 << 64) - 1)
        assert [r.c0, r.c1, r.c2, r.c3] == [(ua >> (16 * k)) & 0xFFFF for k in range(4)]
        assert r.d == (ua ^ ub).bit_count()


def test_hex_to_fp_top_bit(spark):
    r = spark.range(1).select(FP.hex_to_fp(F.lit("ffffffffffffffff")).alias("x"), FP.hex_to_fp(F.lit("8000000000000001")).alias("y")).first()
    assert r.x == -1 and r.y == -(1 << 63) + 1


def test_band_layout_and_masks():
    assert FP.band_layout(4) == [(0, 16), (16, 16), (32, 16), (48, 16)]
    lay = FP.band_layout(9)
    assert sum(w for _, w in lay) == 64 and {w for _, w in lay} == {7, 8}
    assert len(FP.neighbour_masks(16, 2)) == 1 + 16 + 120
    assert all(bin(m).count("1") <= 2 for m in FP.neighbour_masks(16, 2))


def test_simhash_against_python(spark):
    texts = ["the cat sat\non the mat", "a  b\tc", "", "   ", "solo"]

    def py_simhash(t):
        toks = [w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w]
        if not toks:
            return None
        hs = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in toks]
        v = 0
        for i in range(64):
            if 2 * sum((h >> i) & 1 for h in hs) > len(hs):
                v |= 1 << i
        return v - (1 << 64) if v >= 1 << 63 else v

    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.fp for r in FP.simhash_table(df, "k", "t").collect()}
    assert got == {i: py_simhash(t) for i, t in enumerate(texts)}


def test_token_counts_against_python():
    """Sums beyond one lane of 255, tokens of one md5 block and of several, slices, nulls."""
    import pyarrow as pa

    words = ["a", "é", "日本", "\r", "", "  ", "\n", "\t", *(c * n for c, n in zip("efgh", (54, 55, 56, 200)))]
    rnd = random.Random(3)
    texts = [None, "", " ", "a ", " a", "\n" * 600, "a " * 255, "a " * 256, "é " * 1000]
    texts += [rnd.choice([" ", "\n", "\t"]).join(rnd.choices(words, k=k)) for k in (0, 1, 254, 255, 256, 700)]
    want = []
    for t in texts:
        hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in re.split("[ \n\t]", t or "") if w]
        want.append((len(hashes), [sum(h >> i & 1 for h in hashes) for i in range(64)]))
    n, sums = FP.token_counts(pa.array(texts))
    assert list(zip(n.tolist(), sums.tolist())) == want
    n, sums = FP.token_counts(pa.array(texts)[3:9])
    assert list(zip(n.tolist(), sums.tolist())) == want[3:9]
    assert FP.token_counts(pa.array([], pa.string()))[1].shape == (0, 64)


def test_simhash_makes_no_row_of_a_token(spark):
    """Rows of one key count together, a missing key is a key, and no token becomes a row of a plan."""
    df = spark.createDataFrame([("k", "a b"), ("k", "c c"), (None, "a"), ("n", None), ("e", " ")], "`p.q` string, t string")
    fps = FP.simhash_table(df.toDF("p", "t"), "p", "t")
    got = {r.p: r.fp for r in fps.collect()}
    joined = FP.simhash_table(spark.createDataFrame([("k", "a b c c"), (None, "a")], "p string, t string"), "p", "t").collect()
    assert {r.p: r.fp for r in joined} == {k: got[k] for k in ("k", None)} and len(got) == 4
    assert got["n"] is None and got["e"] is None
    assert "Generate" not in spark._jvm.PythonSQLUtils.explainString(fps._jdf.queryExecution(), "simple")


def test_median_bits(spark):
    vec = [float(x) for x in [5, 1, 4, 2, 3, 9, 0, 7]]
    df = spark.createDataFrame([(vec,)], "e array<float>")
    fp = FP.with_median_bits(df, "e").first().fp
    med = (sorted(vec)[3] + sorted(vec)[4]) / 2
    assert fp == sum(1 << i for i, x in enumerate(vec) if x > med)


def test_hashes(spark):
    df = spark.createDataFrame([("abc",), ("é",), (None,)], "s string")
    rows = df.select(content_hash("s", "sha256").alias("a"), blake2b_hex("s").alias("b")).collect()
    assert rows[0].a == hashlib.sha256(b"abc").hexdigest()
    assert rows[1].b == hashlib.blake2b("é".encode()).hexdigest() and len(rows[1].b) == 128
    assert rows[2].a is None and rows[2].b is None
