"""Near-duplicate matching over 64-bit fingerprints.

Everything here works on *distinct fingerprint values*, never on files:
the best match of a target depends only on its fingerprint, so targets are
collapsed to distinct values before the band join and the answer is joined
back by value.  This also collapses the worst skew case - many files with
one identical fingerprint (flat images, boilerplate text) - to a single row on
each side.

Two candidate generators, both equi-joins on (band, value) so Spark plans a
hash/sort-merge join, never a nested loop:

* ``lsh`` - the four 16-bit chunks; a pair is a candidate when it shares one
  chunk at the same position.  Finds every pair at distance <= 3 and misses
  some pairs between 4 and the threshold (the mirrored tool's behaviour).
* ``complete`` - multi-index hashing (Norouzi, Punjani, Fleet, CVPR 2012):
  ``m`` bands, and the target side probes every value within Hamming radius
  ``floor(t / m)`` of its band value.  If distance <= t, some band differs in at
  most floor(t/m) bits (pigeonhole), so recall is exact.  The probe fan-out is a
  fixed, small set of masks per band.

The best match of ``complete`` mode needs no generator where comparing all values, block
against block, is less work than the probes and their pairs (:func:`_best_of_all`): the same answer.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_THRESHOLD, LSH_BANDS
from ..functions.fingerprints import band_array, band_layout, bits_field, hamming, neighbour_masks
from ..session import bound_batches, broadcast_if_small, materialise

MATCH_MODES = ("lsh", "complete")
REFINE_MODES = ("work", "always", "never")
# Probes of a band beyond which no group is dealt out again (they would outnumber its pairs in all but absurd groups).
MAX_BALL = 4096
# How many times less work the next level must be: a pair can be met again by every band its group shares.
GAIN = 4


# Pairs compared block against block (:func:`_best_of_all`) in the time that a probe, or a pair of the band join, takes as a row.
PROBE_ROW, PAIR_ROW = 500, 50
# Fingerprints of a block: two of them and their distances stay in a core's cache.
BLOCK = 32768
# Pairs of a band group that one task lists: a larger group is split.
GROUP_PAIRS = 1 << 22
# Values of a side that show how many of all pairs share a band.
SHOWN = 2048


def fingerprint_index(ref_fps: DataFrame) -> DataFrame:
    """A3 (+F10): distinct ref fingerprint -> smallest path, number of files.

    Input (path, fp); NULL fingerprints are dropped from the index.
    """
    return (
        ref_fps.filter(F.col("fp").isNotNull())
        .groupBy("fp")
        .agg(F.min("path").alias("ref_path"), F.count(F.lit(1)).alias("n_files"))
    )


def _exploded(df: DataFrame) -> DataFrame:
    """``df``, many rows of each row that was read, as a side of an equi-join that is never broadcast.

    Spark's estimate of a generator is the size of what it reads: it would take all bands, probes or subsets of a
    small table for that table and send them through the driver.  Both sides are shuffled instead."""
    return df.hint("merge")


def _ref_bands(index: DataFrame, layout) -> DataFrame:
    return index.select(
        F.col("fp").alias("ref_fp"), "ref_path", F.posexplode(band_array("fp", layout)).alias("band", "val")
    )


def chunk_index(index: DataFrame, bands: int = LSH_BANDS) -> DataFrame:
    """A4: inverted index (band, value) -> number of distinct ref fingerprints, first path."""
    return (
        _ref_bands(index, band_layout(bands))
        .groupBy("band", "val")
        .agg(F.count(F.lit(1)).alias("n_hashes"), F.min("ref_path").alias("first_path"))
    )


def default_complete_bands(threshold: int) -> int:
    """Bands for the complete mode: at least the 4 chunks, and enough that the probe
    radius floor(t/m) stays <= 2 (at most 1 + w + w(w-1)/2 probes per band)."""
    return max(LSH_BANDS, math.ceil((max(threshold, 0) + 1) / 3))


def _width_masks(layout, band_col, radius: int):
    """array<int> of all masks of popcount <= radius for the width of band ``band_col``."""
    widths = sorted({w for _, w in layout})
    mask_arr = {w: F.expr(f"array({','.join(map(str, neighbour_masks(w, radius)))})") for w in widths}
    if len(widths) == 1:
        return mask_arr[widths[0]]
    width_of_band = F.element_at(F.array(*[F.lit(w) for _, w in layout]), band_col + 1)
    masks = None
    for w in widths:
        masks = F.when(width_of_band == w, mask_arr[w]) if masks is None else masks.when(width_of_band == w, mask_arr[w])
    return masks


def _layout(mode: str, threshold: int, bands: int | None):
    if mode == "lsh":
        return band_layout(bands or LSH_BANDS)
    if mode == "complete":
        return band_layout(bands or default_complete_bands(threshold))
    raise ValueError(f"match_mode must be one of {MATCH_MODES}, got {mode!r}")


def _probes(targets: DataFrame, mode: str, threshold: int, bands: int | None):
    """(probe rows (the targets' columns, band, val), band layout) of the candidate generator."""
    layout, own = _layout(mode, threshold, bands), targets.columns
    t = targets.select(*own, F.posexplode(band_array("fp", layout)).alias("band", "val"))
    radius = max(threshold, 0) // len(layout) if mode == "complete" else 0
    if radius == 0:
        return t, layout
    # complete: XOR every mask within the radius (by band width) onto the band value.
    probes = t.select(*own, "band", F.explode(_width_masks(layout, F.col("band"), radius)).alias("_m"), F.col("val").alias("val0")).select(
        *own, "band", F.col("val0").bitwiseXOR(F.col("_m")).alias("val")
    )
    return probes, layout


def _candidate_pairs(targets: DataFrame, index: DataFrame, mode: str, threshold: int, bands: int | None) -> DataFrame:
    """(fp, ref_fp, ref_path) for every candidate pair; a pair may repeat across bands."""
    probes, layout = _probes(targets, mode, threshold, bands)
    return probes.join(_exploded(_ref_bands(index, layout)), ["band", "val"]).select("fp", "ref_fp", "ref_path")


def _dealt_pairs(probes: DataFrame, refs: DataFrame, by: str) -> DataFrame:
    """All pairs of the rows of ``probes`` and ``refs`` that share ``band`` and ``val``, dealt over the tasks by their number.

    The rows are few bytes beside their pairs: adaptive execution would leave them in a few partitions, and a
    group all of whose pairs are wanted in one.  The number of partitions is fixed, and the probes of a
    group of over ``GROUP_PAIRS`` pairs are dealt out by ``by``, each part with the group's refs."""
    spark, key = probes.sparkSession, ["band", "val"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sizes = refs.groupBy(*key).agg(F.count(F.lit(1)).alias("r_n")).join(_exploded(probes.groupBy(*key).agg(F.count(F.lit(1)).alias("t_n"))), key)
    hot = sizes.filter(F.col("r_n") * F.col("t_n") > GROUP_PAIRS).select(*key, F.ceil(F.col("r_n") * F.col("t_n") / GROUP_PAIRS).cast("bigint").alias("parts"))
    hot = materialise(hot, "hot-bands")
    if hot.isEmpty():
        t, r = probes.withColumn("part", F.lit(0).cast("bigint")), refs.withColumn("part", F.lit(0).cast("bigint"))
    else:
        small = broadcast_if_small(hot)
        hot, parts = _exploded(hot) if small is None else small, F.coalesce(F.col("parts"), F.lit(1))
        t = probes.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(by), parts)).drop("parts")
        r = refs.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("parts")
    key = [*key, "part"]
    return t.repartition(n, *key).join(_exploded(r.repartition(n, *key)), key)


def candidates(
    targets: DataFrame,
    index: DataFrame,
    mode: str = "lsh",
    threshold: int = DEFAULT_THRESHOLD,
    bands: int | None = None,
    label: str | None = None,
) -> DataFrame:
    """J4/J5 + A8: distinct candidate pairs with their distance: (fp, ref_fp, ref_path, distance).

    ``targets`` needs a column ``fp``; duplicates are removed first.  Both sides
    hold distinct fingerprints, so a pair repeats only across the bands that
    qualify it; it is kept at its *first* qualifying band (every lower band
    differs by more than the probe radius) - a row-local filter instead of a
    de-duplication shuffle of all pairs.

    With ``label``, a column of the targets, every target row is kept and labels its pairs: (label, fp, ref_fp,
    ref_path, distance).  The rows are labelled on their way into the band join, so no pair is shuffled.
    All pairs are listed, those of a hot group by several tasks (:func:`_dealt_pairs`).
    """
    t = targets.filter(F.col("fp").isNotNull())
    t = t.select("fp").distinct() if label is None else t.select(label, "fp")
    probes, layout = _probes(t, mode, threshold, bands)
    radius = max(threshold, 0) // len(layout) if mode == "complete" else 0
    first = F.lit(True)
    for j, (off, w) in enumerate(layout[:-1]):
        diff = hamming(bits_field("fp", off, w), bits_field("ref_fp", off, w))
        first = first & ((F.col("band") <= j) | (diff > radius))
    pairs = _dealt_pairs(probes, _ref_bands(index, layout), label or "fp").filter(first)
    own = [label] if label is not None else []
    return pairs.select(*own, "fp", "ref_fp", "ref_path", hamming("fp", "ref_fp").alias("distance"))


def _bit(band: str):
    return F.call_function("shiftleft", F.lit(1), F.col(band))


def _pairs_hot_refined(targets: DataFrame, index: DataFrame, mode: str, threshold: int, bands: int | None, refine: str) -> DataFrame:
    """Candidate pairs that can pass the threshold, without emitting all pairs of a
    hot group, however many bands its members agree on.

    Level one groups by (band, value).  In a group every pair agrees on the bands
    ``used`` so far up to the probe radii; if its distance is <= t, the other
    ``m - |used|`` bands differ in at most t bits together, so one of them differs in at
    most floor(t / (m - |used|)) bits (pigeonhole).  A hot group is therefore dealt out
    once more by every unused band, the target probing all values within that radius -
    exact for every pair within the threshold - and what is still hot after that once
    more, until no group is or every band is used.  A group is refined when that is
    estimated to be a fraction of the work: refs x targets against the rows, the probes and - were the
    other bands random - the pairs of the next level, both counted by one partial-combined aggregation a side (``refine="work"``; "always" takes
    the first level whatever it costs, "never" none: the same answer).  A group's bands and values are kept as one 64-bit hash: two groups
    that collide only add pairs, whose distance is checked like any other's.
    """
    probes, layout = _probes(targets, mode, threshold, bands)
    rb = _ref_bands(index, layout)
    m = len(layout)
    others = F.array(*[F.lit(j) for j in range(m)])
    start = [_bit("band").alias("used"), F.xxhash64("band", "val").alias("key")]
    t, r = probes.select("fp", *start), rb.select("ref_fp", "ref_path", *start)
    out = None
    for depth in range(1, m):
        # A group's bands are part of its key: every group has one ``used``.
        radius = max(threshold, 0) // (m - depth)
        ball = len(neighbour_masks(max(w for _, w in layout), radius))
        if ball > MAX_BALL:
            break
        sizes = r.groupBy("key").agg(F.count(F.lit(1)).alias("r_n")).join(_exploded(t.groupBy("key").agg(F.count(F.lit(1)).alias("t_n"))), "key")
        if refine == "work" or depth > 1:
            pairs, kept = F.col("r_n") * F.col("t_n"), min(1.0, ball / (1 << min(w for _, w in layout)))
            sizes = sizes.filter(pairs > GAIN * (m - depth) * (F.col("r_n") + ball * F.col("t_n") + pairs * kept))
        # Narrow keys, read by four joins: written once.  Without any, the plain join is all there is.
        hot = materialise(sizes.select("key"), "hot-groups")
        if hot.isEmpty():
            break
        small = broadcast_if_small(hot)
        hot = _exploded(hot) if small is None else small
        cold = t.join(hot, "key", "left_anti").join(_exploded(r), "key").select("fp", "ref_fp", "ref_path")
        out = cold if out is None else out.unionByName(cold)

        def deal(side: DataFrame, hot: DataFrame = hot) -> DataFrame:
            """The hot rows of a side by every band that their group has not used."""
            free = side.join(hot, "key", "left_semi").select("*", F.explode(others).alias("j"))
            return free.filter(F.col("used").bitwiseAND(_bit("j")) == 0)

        def step(w) -> list:
            return [F.col("used").bitwiseOR(_bit("j")).alias("used"), F.col("key").bitwiseXOR(F.xxhash64("j", w)).alias("key")]

        def band_j(col: str):
            return F.element_at(band_array(col, layout), F.col("j") + 1)

        near = deal(t).select("fp", "used", "key", "j", band_j("fp").alias("w"), F.explode(_width_masks(layout, F.col("j"), radius)).alias("_m"))
        # The same bands in another order are the same group.
        t = near.select("fp", *step(F.col("w").bitwiseXOR(F.col("_m")))).distinct()
        r = deal(r).select("ref_fp", "ref_path", *step(band_j("ref_fp"))).distinct()
    rest = t.join(_exploded(r), "key").select("fp", "ref_fp", "ref_path")
    return rest if out is None else out.unionByName(rest)


def _all_pairs_pay(t: DataFrame, index: DataFrame, threshold: int, bands: int | None) -> bool:
    """Whether comparing a value with the whole index takes less than its probes and the pairs they meet.

    The pairs are estimated from the values of either side whose hashes come first: low-entropy bands (texts of one
    language agree in most bits) are met by a large share of all pairs, however wide they are."""
    layout = _layout("complete", threshold, bands)
    radius = max(threshold, 0) // len(layout)
    balls = sum(len(neighbour_masks(w, radius)) for _, w in layout)
    n = index.count()
    if n <= PROBE_ROW * balls:
        return True
    a, b = (
        np.array([r[0] for r in side.select("fp").orderBy(F.xxhash64("fp")).limit(SHOWN).collect()], dtype=np.int64).view(np.uint64)
        for side in (t, index)
    )
    shared = 0.0
    for off, w in layout:
        mask = np.uint64((1 << w) - 1 << off)
        shared += float(np.mean([(np.bitwise_count((b ^ x) & mask) <= radius).mean() for x in a])) if len(a) else 0.0
    return n <= PROBE_ROW * balls + PAIR_ROW * shared * n


def _nearest_in(targets: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first nearest of ``refs``, its distance) for every one of ``targets`` (both ``uint64``)."""
    at, least = np.empty(len(targets), dtype=np.int64), np.empty(len(targets), dtype=np.uint8)
    diff, bits = np.empty_like(refs), np.empty(len(refs), dtype=np.uint8)
    for i, x in enumerate(targets):
        np.bitwise_xor(refs, x, out=diff)
        np.bitwise_count(diff, out=bits)
        at[i] = j = bits.argmin()
        least[i] = bits[j]
    return at, least


def _best_of_all(t: DataFrame, index: DataFrame, threshold: int) -> DataFrame:
    """(fp, near_path, distance) by comparing every value of ``t`` (fp, distinct) with the whole index, block against block.

    Blocks hold about ``BLOCK`` values as one array, those of the index in the order of their paths: the first
    nearest of a block has its smallest path.  A task holds a block of either side, whatever the sizes."""
    spark = t.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    bound_batches(spark)

    def blocks(side: DataFrame, least: int, *order: str) -> DataFrame:
        n = max(least, math.ceil(side.count() / BLOCK))
        members = F.sort_array(F.collect_list(F.struct(*order)))["fp"]
        return side.groupBy(F.pmod(F.xxhash64("fp"), F.lit(n)).alias("block")).agg(members.alias("fps")).select("fps")

    tb = blocks(t, 2 * tasks, "fp").repartition(tasks)
    rb = materialise(blocks(index, 1, "ref_path", "fp"), "blocks")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            t_col, r_col = batch.column("t"), batch.column("r")
            for i in range(len(batch)):
                targets, refs = (c[i].values.to_numpy().view(np.uint64) for c in (t_col, r_col))
                at, least = _nearest_in(targets, refs)
                ok = np.flatnonzero(least <= max(threshold, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(targets[ok].view(np.int64)), pa.array(refs[at[ok]].view(np.int64)), pa.array(least[ok].astype(np.int32))],
                    names=["fp", "ref_fp", "distance"],
                )

    met = tb.select(F.col("fps").alias("t")).crossJoin(rb.select(F.col("fps").alias("r"))).mapInArrow(run, "fp bigint, ref_fp bigint, distance int")
    paths = index.select(F.col("fp").alias("ref_fp"), "ref_path")
    best = met.join(paths, "ref_fp").groupBy("fp").agg(F.min(F.struct("distance", "ref_path")).alias("_b"))
    return best.select("fp", F.col("_b.ref_path").alias("near_path"), F.col("_b.distance").alias("distance"))


def best_matches(
    targets: DataFrame,
    index: DataFrame,
    threshold: int = DEFAULT_THRESHOLD,
    mode: str = "lsh",
    bands: int | None = None,
    refine: str = "work",
) -> DataFrame:
    """R3 (J3+J4/J5+P10+F8+A9): per distinct target fingerprint, the closest ref within
    the threshold, ties to the smallest path: (fp, near_path, distance).

    Equal fingerprints (distance 0) always match, even for a negative threshold.
    The arg-min is ``min(struct(distance, path))``, which combines partially
    before its shuffle; duplicate pairs from several bands do not change a min,
    so no separate de-duplication shuffle is needed.  Hot band groups are
    refined (see :func:`_pairs_hot_refined`) - same answer, bounded pair output.
    In ``complete`` mode all values are compared where that is estimated to be less work
    (``refine="work"``, see :func:`_best_of_all`) - the same answer again.
    """
    if refine not in REFINE_MODES:
        raise ValueError(f"refine must be one of {REFINE_MODES}, got {refine!r}")
    t = targets.select("fp").filter(F.col("fp").isNotNull())
    if mode == "complete" or refine != "never":
        # Each value becomes many probes, in ``lsh`` mode those of the hot groups: a fixed number of partitions, which
        # adaptive execution does not coalesce by the few bytes of the values.
        spark = targets.sparkSession
        t = t.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "fp")
    t = t.distinct()
    if mode == "complete" and refine == "work" and _all_pairs_pay(t, index, threshold, bands):
        return _best_of_all(t, index, threshold)
    if refine != "never" and len(_layout(mode, threshold, bands)) > 1:
        raw = _pairs_hot_refined(t, index, mode, threshold, bands, refine)
    else:
        raw = _candidate_pairs(t, index, mode, threshold, bands)
    pairs = raw.withColumn("distance", hamming("fp", "ref_fp"))
    ok = pairs.filter((F.col("distance") <= F.lit(threshold)) | (F.col("distance") == 0))
    best = ok.groupBy("fp").agg(F.min(F.struct("distance", "ref_path")).alias("_b"))
    return best.select("fp", F.col("_b.ref_path").alias("near_path"), F.col("_b.distance").alias("distance"))


def _band_subsets(layout) -> list[tuple[int, int, int]]:
    """(subset id, 64-bit mask of its bands as signed bigint, inclusion-exclusion sign)
    for every non-empty subset of the bands."""
    out = []
    for sub in range(1, 1 << len(layout)):
        mask = 0
        for b, (off, w) in enumerate(layout):
            if sub >> b & 1:
                mask |= ((1 << w) - 1) << off
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append((sub, signed, 1 if bin(sub).count("1") % 2 else -1))
    return out


# Inclusion-exclusion needs 2^bands - 1 masked keys per row: more bands are refused.
MAX_COUNT_BANDS = 8


def _lsh_candidate_counts(targets: DataFrame, index: DataFrame, layout) -> DataFrame:
    """(fp, n_candidates) for LSH candidates without emitting any pair.

    The refs sharing *every* band of a subset B with a target are the refs whose
    bits under mask(B) equal the target's, so |S_0 u ... u S_m-1| is
    sum over B of (-1)^(|B|+1) * #{ref : ref & mask(B) = fp & mask(B)}.  The ref
    side is one count per (subset, masked value) - a partial-combined
    aggregation - and each target meets one row per subset: output and shuffle
    stay linear in the inputs even when one band value is shared by a third of
    all refs.
    """
    subs = F.array(
        *[F.struct(F.lit(k).alias("s"), F.lit(mask).cast("bigint").alias("mask"), F.lit(sign).alias("sign")) for k, mask, sign in _band_subsets(layout)]
    )
    ref_keys = (
        index.select("fp", F.explode(subs).alias("x"))
        .select(F.col("x.s").alias("s"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
        .groupBy("s", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    t = targets.select("fp").filter(F.col("fp").isNotNull()).distinct()
    tk = t.select("fp", F.explode(subs).alias("x")).select(
        "fp", F.col("x.s").alias("s"), F.col("x.sign").alias("sign"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key")
    )
    return tk.join(_exploded(ref_keys), ["s", "key"]).groupBy("fp").agg(F.sum(F.col("sign") * F.col("n")).alias("n_candidates"))


def candidate_counts(targets: DataFrame, index: DataFrame, mode: str = "lsh", threshold: int = DEFAULT_THRESHOLD, bands: int | None = None) -> DataFrame:
    """A10: number of distinct candidate ref fingerprints per target file: (path, n_candidates).

    Targets without a fingerprint or without candidates get 0.  In ``lsh`` mode
    the count comes from :func:`_lsh_candidate_counts` (no pairs); in
    ``complete`` mode, whose probe balls do not decompose into masked keys, the
    distinct candidate pairs are counted.
    """
    layout = band_layout(bands or LSH_BANDS)
    if mode == "lsh" and len(layout) > MAX_COUNT_BANDS:
        raise ValueError(f"candidate counts take at most {MAX_COUNT_BANDS} bands, got {len(layout)}")
    if mode == "lsh":
        per_fp = _lsh_candidate_counts(targets, index, layout)
    else:
        per_fp = candidates(targets, index, mode, threshold, bands).groupBy("fp").agg(
            F.count(F.lit(1)).alias("n_candidates")
        )
    return targets.select("path", "fp").join(per_fp, "fp", "left").select(
        "path", F.coalesce(F.col("n_candidates"), F.lit(0)).cast("bigint").alias("n_candidates")
    )
