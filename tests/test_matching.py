"""Banded Hamming joins against brute force on random fingerprints."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsieve.operators import near as N
from twinsieve.session import broadcast_if_small, materialise, written_bytes


def _to_signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def _data(n_ref=120, n_tgt=80, seed=3):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(n_ref)]
    ref = [(f"r/{i:04d}.jpg", _to_signed(v)) for i, v in enumerate(base)]
    tgt = []
    for i in range(n_tgt):
        v = base[rnd.randrange(n_ref)]
        for b in rnd.sample(range(64), rnd.randrange(0, 14)):  # flip 0..13 bits
            v ^= 1 << b
        tgt.append((f"t/{i:04d}.jpg", _to_signed(v)))
    ref.append(("r/dup_a.jpg", ref[0][1]))  # same fingerprint, larger path
    return ref, tgt


def _brute(ref, tgt, t, lsh):
    out = {}
    for tp, tv in tgt:
        best = None
        for rp, rv in ref:
            d = ((tv ^ rv) & ((1 << 64) - 1)).bit_count()
            share = any(((tv >> (16 * k)) & 0xFFFF) == ((rv >> (16 * k)) & 0xFFFF) for k in range(4))
            if lsh and not share:
                continue
            if d <= t or d == 0:
                cand = (d, rp)
                best = cand if best is None or cand < best else best
        if best:
            out[tp] = best
    return out


@pytest.mark.parametrize("mode,threshold", [("lsh", 8), ("complete", 8), ("complete", 12), ("lsh", 3)])
def test_best_matches_equal_brute_force(spark, mode, threshold):
    ref, tgt = _data()
    rdf = spark.createDataFrame(ref, "path string, fp long")
    tdf = spark.createDataFrame(tgt, "path string, fp long")
    idx = N.fingerprint_index(rdf)
    best = N.best_matches(tdf, idx, threshold=threshold, mode=mode)
    got = {r.path: (r.distance, r.near_path) for r in tdf.join(best, "fp").collect()}
    assert got == _brute(ref, tgt, threshold, lsh=(mode == "lsh"))


def test_lsh_subset_of_complete_and_radius3_complete(spark):
    ref, tgt = _data(seed=11)
    rdf = spark.createDataFrame(ref, "path string, fp long")
    tdf = spark.createDataFrame(tgt, "path string, fp long")
    idx = N.fingerprint_index(rdf)
    lsh = {r.path for r in tdf.join(N.best_matches(tdf, idx, 8, "lsh"), "fp").collect()}
    comp = {r.path for r in tdf.join(N.best_matches(tdf, idx, 8, "complete"), "fp").collect()}
    assert lsh <= comp
    # every pair within distance 3 shares a 16-bit chunk, so LSH equals complete there
    l3 = tdf.join(N.best_matches(tdf, idx, 3, "lsh"), "fp").select("path", "distance").collect()
    c3 = tdf.join(N.best_matches(tdf, idx, 3, "complete"), "fp").select("path", "distance").collect()
    assert sorted(l3) == sorted(c3)


def test_equal_fingerprint_matches_even_with_negative_threshold(spark):
    rdf = spark.createDataFrame([("r/b.jpg", 42), ("r/a.jpg", 42)], "path string, fp long")
    tdf = spark.createDataFrame([("t/x.jpg", 42), ("t/y.jpg", 43)], "path string, fp long")
    best = N.best_matches(tdf, N.fingerprint_index(rdf), threshold=-1)
    rows = {r.path: (r.near_path, r.distance) for r in tdf.join(best, "fp").collect()}
    assert rows == {"t/x.jpg": ("r/a.jpg", 0)}


def test_candidate_counts_zero_for_no_candidates(spark):
    rdf = spark.createDataFrame([("r/a.jpg", 0)], "path string, fp long")
    tdf = spark.createDataFrame([("t/x.jpg", -1), ("t/y.jpg", 1)], "path string, fp long")
    got = {r.path: r.n_candidates for r in N.candidate_counts(tdf, N.fingerprint_index(rdf)).collect()}
    assert got == {"t/x.jpg": 0, "t/y.jpg": 1}


@pytest.mark.parametrize("threshold", [8, 5])
def test_hot_band_refinement_is_exact(spark, threshold):
    # Many distinct fingerprints sharing chunk 0 (a hot band group on both sides).
    rnd = random.Random(5)
    hot_chunk = 0xBEEF
    ref, tgt = [], []
    for i in range(150):
        v = (rnd.getrandbits(48) << 16) | hot_chunk
        ref.append((f"r/{i:04d}.jpg", _to_signed(v)))
    for i in range(100):
        v = ref[rnd.randrange(150)][1] & ((1 << 64) - 1)
        for b in rnd.sample(range(16, 64), rnd.randrange(0, 12)):
            v ^= 1 << b
        tgt.append((f"t/{i:04d}.jpg", _to_signed(v)))
    rdf = spark.createDataFrame(ref, "path string, fp long")
    tdf = spark.createDataFrame(tgt, "path string, fp long")
    idx = N.fingerprint_index(rdf)
    # refine="always" forces the refined path for the shared chunk
    best = N.best_matches(tdf, idx, threshold=threshold, mode="lsh", refine="always")
    got = {r.path: (r.distance, r.near_path) for r in tdf.join(best, "fp").collect()}
    assert got == _brute(ref, tgt, threshold, lsh=True)


def _hot_data(seed=7, n_ref=150, n_tgt=100, max_flips=12):
    # Many distinct fingerprints sharing their lowest 16 bits: one hot band group.
    rnd = random.Random(seed)
    ref = [(f"r/{i:04d}.jpg", _to_signed((rnd.getrandbits(48) << 16) | 0xBEEF)) for i in range(n_ref)]
    tgt = []
    for i in range(n_tgt):
        v = ref[rnd.randrange(n_ref)][1] & ((1 << 64) - 1)
        for b in rnd.sample(range(64), rnd.randrange(0, max_flips)):
            v ^= 1 << b
        tgt.append((f"t/{i:04d}.jpg", _to_signed(v)))
    return ref, tgt


@pytest.mark.parametrize("threshold,bands", [(8, None), (6, 9), (-1, None)])
def test_hot_band_refinement_complete_is_exact(spark, threshold, bands):
    ref, tgt = _hot_data()
    rdf = spark.createDataFrame(ref, "path string, fp long")
    tdf = spark.createDataFrame(tgt, "path string, fp long")
    idx = N.fingerprint_index(rdf)
    best = N.best_matches(tdf, idx, threshold=threshold, mode="complete", bands=bands, refine="always")
    got = {r.path: (r.distance, r.near_path) for r in tdf.join(best, "fp").collect()}
    assert got == _brute(ref, tgt, threshold, lsh=False)


def _brute_counts(ref, tgt, bands):
    width = 64 // bands
    mask = (1 << width) - 1
    ref_fps = {v & ((1 << 64) - 1) for _, v in ref}
    out = {}
    for tp, tv in tgt:
        u = tv & ((1 << 64) - 1)
        out[tp] = sum(any((u >> (width * k)) & mask == (r >> (width * k)) & mask for k in range(bands)) for r in ref_fps)
    return out


@pytest.mark.parametrize("hot,bands", [(False, 4), (True, 4), (True, 8)])
def test_candidate_counts_inclusion_exclusion_equals_brute(spark, hot, bands):
    ref, tgt = _hot_data() if hot else _data()
    rdf = spark.createDataFrame(ref, "path string, fp long")
    tdf = spark.createDataFrame(tgt, "path string, fp long")
    got = {r.path: r.n_candidates for r in N.candidate_counts(tdf, N.fingerprint_index(rdf), bands=bands).collect()}
    assert got == _brute_counts(ref, tgt, bands)


def _brute_pairs(ref, tgt, layout, radius):
    ref_fps = {v & ((1 << 64) - 1) for _, v in ref}
    out = set()
    for _, tv in tgt:
        u = tv & ((1 << 64) - 1)
        for r in ref_fps:
            if any((((u ^ r) >> off) & ((1 << w) - 1)).bit_count() <= radius for off, w in layout):
                out.add((_to_signed(u), _to_signed(r), ((u ^ r)).bit_count()))
    return out


@pytest.mark.parametrize("mode,threshold,bands", [("lsh", 8, None), ("complete", 8, None), ("complete", 6, 9)])
def test_candidates_are_distinct_and_complete(spark, mode, threshold, bands):
    from twinsieve.functions.fingerprints import band_layout

    ref, tgt = _hot_data(seed=11, max_flips=20)
    ref += _data(seed=4)[0]
    rdf = spark.createDataFrame(ref, "path string, fp long")
    tdf = spark.createDataFrame(tgt, "path string, fp long")
    rows = N.candidates(tdf, N.fingerprint_index(rdf), mode=mode, threshold=threshold, bands=bands).collect()
    got = [(r.fp, r.ref_fp, r.distance) for r in rows]
    assert len(got) == len(set(got))  # no duplicate pairs without a distinct
    m = bands or (4 if mode == "lsh" else N.default_complete_bands(threshold))
    radius = 0 if mode == "lsh" else max(threshold, 0) // m
    assert set(got) == _brute_pairs(ref, tgt, band_layout(m), radius)


@pytest.mark.parametrize("mode", N.MATCH_MODES)
def test_pairs_of_hot_groups_are_dealt_over_tasks(spark, monkeypatch, mode):
    """One band group holds most pairs: the same pairs, listed by many tasks."""
    ref, tgt = _hot_data()
    tdf, idx = spark.createDataFrame(tgt, "path string, fp long"), N.fingerprint_index(spark.createDataFrame(ref, "path string, fp long"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = [rows(N.candidates(tdf, idx, mode=mode, label=label)) for label in (None, "path")]
    monkeypatch.setattr(N, "GROUP_PAIRS", 500)
    assert [rows(N.candidates(tdf, idx, mode=mode, label=label)) for label in (None, "path")] == whole
    pairs = N.candidates(tdf, idx, mode=mode, label="path")
    most = max(r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect())
    assert len(whole[1]) > 4000 and most < len(whole[1]) / 2


def test_refinement_modes_agree_on_a_shared_band(spark):
    import random

    from twinsieve.operators import near as N

    rnd = random.Random(7)
    hot = 0x1234
    refs = [(f"r{i}", (rnd.getrandbits(47) << 16) | (hot if i % 3 == 0 else rnd.getrandbits(16))) for i in range(300)]
    tgts = [(f"t{i}", refs[i][1] ^ (1 << (20 + i % 30)) if i < 150 else (rnd.getrandbits(47) << 16) | hot) for i in range(200)]
    idx = N.fingerprint_index(spark.createDataFrame(refs, "path string, fp long"))
    tdf = spark.createDataFrame(tgts, "path string, fp long")
    for mode in N.MATCH_MODES:
        got = [sorted(map(tuple, N.best_matches(tdf, idx, mode=mode, refine=r).collect())) for r in N.REFINE_MODES]
        assert got[0] == got[1] == got[2] and got[0]


@pytest.mark.parametrize("threshold", [8, 3, -1])
def test_blocks_of_all_pairs_are_exact(spark, monkeypatch, threshold):
    """Many blocks, equal distances within a block and across blocks: the smallest path wins."""
    monkeypatch.setattr(N, "BLOCK", 16)
    ref, tgt = _hot_data(n_ref=200, n_tgt=120)
    ref += [(f"r/{9 - i}-{p[2:]}", _to_signed((v ^ (1 << 20 + i)) & ((1 << 64) - 1))) for i in range(3) for p, v in ref[:60]]
    tdf = spark.createDataFrame(tgt, "path string, fp long")
    idx = N.fingerprint_index(spark.createDataFrame(ref, "path string, fp long"))
    best = N._best_of_all(tdf.select("fp").distinct(), idx, threshold)
    got = {r.path: (r.distance, r.near_path) for r in tdf.join(best, "fp").collect()}
    assert got == _brute(ref, tgt, threshold, lsh=False) != {}
    empty = tdf.limit(0)
    assert N._best_of_all(empty.select("fp"), idx, threshold).count() == 0
    assert N._best_of_all(tdf.select("fp"), N.fingerprint_index(empty), threshold).count() == 0


def test_all_pairs_only_where_they_are_less_work(spark, monkeypatch):
    """Values whose bands nearly all share are compared block against block, those that few share are probed."""
    rnd = random.Random(11)
    monkeypatch.setattr(N, "PROBE_ROW", 1)
    alike = [(f"r/{i}", sum(rnd.randrange(20) // 19 << b for b in range(63))) for i in range(900)]
    apart = [(f"r/{i}", rnd.getrandbits(63)) for i in range(1800)]
    for rows, pays in ((alike, True), (apart, False)):
        df = spark.createDataFrame(rows, "path string, fp long")
        assert N._all_pairs_pay(df.select("fp"), N.fingerprint_index(df), 8, None) is pays
        plan = spark._jvm.PythonSQLUtils.explainString(N.best_matches(df, N.fingerprint_index(df), 8, "complete")._jdf.queryExecution(), "simple")
        assert ("Generate" not in plan) is pays


def test_refused_parameters(spark):
    import pytest

    from twinsieve.functions.fingerprints import with_median_bits
    from twinsieve.operators import near as N

    empty = spark.createDataFrame([], "path string, fp long")
    with pytest.raises(ValueError):
        N.best_matches(empty, N.fingerprint_index(empty), refine="sometimes")
    with pytest.raises(ValueError):
        N.candidate_counts(empty, N.fingerprint_index(empty), bands=16)
    wide = spark.createDataFrame([([float(x) for x in range(65)],)], "v array<double>")
    with pytest.raises(Exception, match="64 elements"):
        with_median_bits(wide, "v").collect()


@pytest.mark.parametrize("mode,threshold,bands", [("lsh", 8, None), ("complete", 8, 9), ("complete", 8, None), ("complete", 3, None), ("lsh", 0, None)])
def test_groups_that_share_two_bands_are_dealt_out_again(spark, mode, threshold, bands):
    """A third of all fingerprints agree on two bands: the answer is that of brute force and the pairs stay far below all of the group's."""
    rnd = np.random.default_rng(5)
    n = 2400
    def some(k):
        free = rnd.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, k, dtype=np.uint64)
        hot = np.arange(k) % 3 == 0
        free[hot] = (free[hot] & np.uint64(0x00000000FFFFFFFF)) | np.uint64(0xABCD123400000000)
        return free
    refs, targets = some(n), some(n)
    targets[:60] = refs[:60] ^ (np.uint64(1) << rnd.integers(0, 64, 60).astype(np.uint64))
    targets[60:75] = refs[60:75]
    signed = lambda x: x.view(np.int64).tolist()
    idx = N.fingerprint_index(spark.createDataFrame([(f"r{i:05d}", f) for i, f in enumerate(signed(refs))], "path string, fp long"))
    tdf = spark.createDataFrame([(f,) for f in signed(targets)], "fp long").distinct()
    distance = np.bitwise_count(targets[:, None] ^ refs[None, :])
    ok = distance <= threshold
    if mode == "lsh":
        parts = lambda x: np.stack([(x >> np.uint64(16 * b)) & np.uint64(0xFFFF) for b in range(4)], 1)
        ok &= (parts(targets)[:, None, :] == parts(refs)[None, :, :]).any(2)
    ok |= distance == 0
    want = {}
    for i, f in enumerate(signed(targets)):
        near = np.flatnonzero(ok[i])
        if len(near):
            d, r = min((int(distance[i, k]), int(k)) for k in near)
            want[f] = (f"r{r:05d}", d)
    got = {r.fp: (r.near_path, r.distance) for r in N.best_matches(tdf, idx, threshold=threshold, mode=mode, bands=bands).collect()}
    assert got == want and want
    pairs = N._pairs_hot_refined(tdf, idx, mode, threshold, bands, "work").count()
    if threshold < 8:  # elsewhere probing another band costs more than this group's pairs
        assert pairs < n * n / 9 / 2  # less than half of what the hot group alone would emit once, let alone a band


def _broadcast_generators(df):
    """Generators below a broadcast in the plan of ``df``."""
    lines = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").splitlines()
    depth = lambda line: re.search(r"[A-Za-z]", line).start()
    out, under = [], None
    for line in (x for x in lines if re.search(r"[A-Za-z]", x)):
        if under is not None and depth(line) <= under:
            under = None
        if under is None and "BroadcastExchange" in line:
            under = depth(line)
        elif under is not None and "Generate " in line:
            out.append(line)
    return out


def test_bands_and_probes_are_never_broadcast(spark):
    """The written tables are far below the broadcast threshold, their probes need not be."""
    ref, tgt = _data()
    targets = materialise(spark.createDataFrame(tgt, "path string, fp bigint"), "t")
    index = materialise(N.fingerprint_index(spark.createDataFrame(ref, "path string, fp bigint")), "r")
    for mode in N.MATCH_MODES:
        for refine in N.REFINE_MODES:
            assert not _broadcast_generators(N.best_matches(targets, index, 8, mode=mode, refine=refine)), (mode, refine)
        assert not _broadcast_generators(N.candidates(targets, index, mode=mode)), mode
    assert not _broadcast_generators(N._lsh_candidate_counts(targets, index, N.band_layout(4)))


@pytest.mark.parametrize("mode", N.MATCH_MODES)
def test_labelled_candidates_shuffle_no_pairs(spark, mode):
    ref, tgt = _data()
    targets = materialise(spark.createDataFrame([*tgt, ("t/copy.jpg", tgt[0][1]), ("t/none.jpg", None)], "path string, fp bigint"), "t")
    index = materialise(N.fingerprint_index(spark.createDataFrame(ref, "path string, fp bigint")), "r")
    joined = targets.join(N.candidates(targets, index, mode=mode), "fp")
    labelled = N.candidates(targets, index, mode=mode, label="path")
    rows = lambda df: sorted(map(tuple, df.select("path", "fp", "ref_fp", "ref_path", "distance").collect()))
    assert rows(labelled) == rows(joined) != []
    plan = spark._jvm.PythonSQLUtils.explainString(labelled._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan[: plan.index("Join")]


def test_packed_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    """Paths are packed in the files: what a broadcast would take of the driver is many times as much."""
    old, limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), 1 << 20
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(limit))
    try:
        rows = spark.range(4000).select(F.concat(F.lit("d/" * 200), F.col("id").cast("string")).alias("path"), F.xxhash64("id").alias("fp"))
        packed, few = materialise(rows, "packed"), materialise(rows.limit(10), "few")
        assert written_bytes(packed) * 5 < limit
        assert broadcast_if_small(packed) is None and broadcast_if_small(few) is not None
        plan = lambda df: spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        best = N.best_matches(packed, materialise(N.fingerprint_index(packed), "index"), 8)
        assert "Broadcast" not in plan(packed.join(best, "fp"))
        assert "Broadcast" not in plan(rows.join(packed.select("path"), "path", "left_semi"))
        assert "BroadcastHashJoin" in plan(rows.join(few.select("path"), "path", "left_semi"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_few_fingerprints_are_dealt_out_before_they_become_probes(spark):
    """Adaptive execution would make one partition, and one task, of the few bytes of the targets' values."""
    ref, tgt = _data()
    targets, index = spark.createDataFrame(tgt, "path string, fp bigint"), N.fingerprint_index(spark.createDataFrame(ref, "path string, fp bigint"))
    plan = spark._jvm.PythonSQLUtils.explainString(N.best_matches(targets, index, 8)._jdf.queryExecution(), "simple")
    assert "REPARTITION_BY_NUM" in plan
