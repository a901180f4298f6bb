"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets its Hamming distances to ``pivots`` reference
fingerprints (the pivot table, precomputed once, eight distances to a
``bigint``).  By the triangle inequality two fingerprints at distance <= r differ
by at most r in every coordinate, so a pair whose largest coordinate difference
exceeds r is discarded from the table alone; survivors are verified by the
population count of the exclusive or.

The pairs the tables are asked about come from equi-joins that lose nothing: the
64 bits are cut into 2r blocks; r differing bits touch at most r of them, so some
r blocks agree (20 keys of about 32 bits each for r = 3).  A key shared by more
than ``hot_group`` distinct fingerprints is split once more, by the same rule on
its remaining bits: groups then agree in about 48 bits and hold at most 2^16
values, whatever the input.  The split changes no answer (tested at several
settings).  A pair is reported at the first key its members share.

Equal fingerprints are collapsed before any join, so exact copies never meet each
other; a fingerprint has at most C(64,1)+C(64,2)+C(64,3) links.

Defined results: null text counts as empty; a text without words has fingerprint
zero and links like any other; fewer words than a shingle make one shingle of the
whole sequence; documents without ``doc_id`` take part but never name a group (a group
of such documents alone has a null id); repeated rows are equal fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import Scratch, field, packed
from twinsieve.llm.components import components

BITS = 64


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the ``shingle``-word sequences of ``text`` (UTF-8 bytes), repeats included."""
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    h = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory on very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed bigint."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = [signed(fingerprint(t.as_py(), shingle, seed)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(bits: list[int], max_bits: int) -> list[int]:
    """Masks over ``bits``: of ``2 * max_bits`` blocks, every choice of ``max_bits`` blocks."""
    if max_bits == 0:
        return [sum(1 << b for b in bits)]
    blocks = [sum(1 << int(b) for b in x) for x in np.array_split(np.array(bits), 2 * max_bits)]
    return [sum(c) for c in combinations(blocks, max_bits)]


def pivot_table(fp: Column, pivots: int, seed: int = 7) -> list[Column]:
    """Distances to the reference fingerprints, eight to a bigint (each below 65: seven bits)."""
    rng = np.random.default_rng(seed)
    refs = [signed(int(x)) for x in rng.integers(0, 1 << 63, pivots, dtype=np.uint64) * 2 + rng.integers(0, 2, pivots, dtype=np.uint64)]
    packs = []
    for at in range(0, pivots, 8):
        pack = F.lit(0).cast("long")
        for i, r in enumerate(refs[at : at + 8]):
            pack = pack + F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("long"), 7 * i)
        packs.append(pack.alias(f"p{at // 8}"))
    return packs


def _coordinates_within(a: str, b: str, pivots: int, max_bits: int) -> Column:
    def at(row, i):
        return F.shiftright(F.col(f"{row}.p{i // 8}"), 7 * (i % 8)).bitwiseAND(F.lit(127))

    ok = F.lit(True)
    for i in range(pivots):
        ok = ok & (F.abs(at(a, i) - at(b, i)) <= max_bits)
    return ok


def links(distinct: DataFrame, scratch: Scratch, max_bits: int = 3, pivots: int = 16, hot_group: int = 128) -> DataFrame:
    """All pairs (u < v) of distinct fingerprints (column ``fp``) at distance 1 to ``max_bits``."""
    masks = block_masks(list(range(BITS)), max_bits)
    packs = [f"p{i}" for i in range(-(-pivots // 8))]
    table = scratch.save(distinct.select("fp", *pivot_table(F.col("fp"), pivots)), "pivots")

    def keyed(df: DataFrame, choices: list[tuple[int, int]], *keep: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for c, m in choices])
        return df.select("fp", *packs, *keep, F.inline(keys))

    first = keyed(table, list(enumerate(masks)))
    hot = scratch.save(first.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > hot_group).select("c", "k", F.lit(True).alias("hot")), "hot")
    marked = first.join(hot, ["c", "k"], "left")
    cold = marked.where("hot is null").drop("hot")

    def meet(df: DataFrame, on: list[str]) -> DataFrame:
        a, b = df.alias("a"), df.alias("b")
        x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
        cond = F.col("a.fp") < F.col("b.fp")
        for k in on:
            cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        cond = cond & _coordinates_within("a", "b", pivots, max_bits) & (F.bit_count(x) <= max_bits)
        for c, m in enumerate(masks[:-1]):  # reported at the first key the two share
            cond = cond & ((F.col("a.c") <= c) | (x.bitwiseAND(F.lit(signed(m))) != 0))
        return a.join(b, cond).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))

    warm = marked.where("hot").drop("hot")
    finer = None
    for c, m in enumerate(masks):
        rest = block_masks([i for i in range(BITS) if not m >> i & 1], max_bits)
        choices = F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(signed(r))).alias("kj")) for j, r in enumerate(rest)])
        finer = choices if finer is None else F.when(F.col("c") == c, choices).otherwise(finer)
    fine = warm.select("fp", *packs, "c", "k", F.inline(finer))
    return meet(cold, ["c", "k"]).unionByName(meet(fine, ["c", "k", "j", "kj"]).distinct())


def _grouped(docs: DataFrame, scratch: Scratch, shingle: int, max_bits: int, pivots: int, hot_group: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, component, component_id) of every fingerprint."""
    fps = scratch.save(fingerprints(docs.select("doc_id", "text"), shingle, seed), "fingerprints")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    found = components(links(distinct, scratch, max_bits, pivots, hot_group), scratch)
    named = distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"))
    named = scratch.save(named, "named")
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return fps, scratch.save(named.join(least, "component").select("fp", "component", "component_id"), "lookup")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, pivots: int = 16,
                    hot_group: int = 128, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``; the id is the smallest ``doc_id`` reachable by links."""
    fps, lookup = _grouped(docs, Scratch(docs.sparkSession, "simhash"), shingle, max_bits, pivots, hot_group, seed)
    # A fingerprint shared by very many rows: both sides are shuffled for this join alone, AQE splits it.
    return fps.join(lookup, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, shingle: int = 3, max_bits: int = 3, pivots: int = 16,
                         hot_group: int = 128, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each group of linked texts: one whose ``doc_id`` is the group's smallest.

    The ids to remove - normally far fewer than those that stay - are anti-joined, so the texts are
    shuffled only when that list is too large to broadcast.  An id names a group only where it is
    unique: rows whose ``doc_id`` is null or repeated are decided by their text.  Of the rows that carry a
    group's smallest id, one stays; rows of other texts under the same id are groups of their own; a row without id goes
    where its group has a named row, and one of a nameless group stays."""
    scratch = Scratch(docs.sparkSession, "keep")
    fps, lookup = _grouped(docs, scratch, shingle, max_bits, pivots, hot_group, seed)
    marked = fps.join(lookup, "fp")
    ids = marked.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    ids = scratch.save(ids.where("not stays or n > 1"), "ids")
    repeated = ids.where("n > 1").select("doc_id")
    nameless = fps.where("doc_id is null").limit(1).count()
    if not nameless and not repeated.limit(1).count():
        return docs.join(ids.select("doc_id"), "doc_id", "left_anti")
    alone = docs.where("doc_id is not null").join(ids.select("doc_id"), "doc_id", "left_anti")
    unsure = docs.where("doc_id is null").unionByName(docs.join(repeated, "doc_id", "left_semi"))
    text = F.coalesce(field("text"), F.lit(""))
    rows = packed(unsure).withColumn("th", F.xxhash64(text))
    # The texts in question once more, told apart by their hash: (th, fp, component) of each.
    again = fingerprints(rows.select(F.col("th").alias("doc_id"), text.alias("text")), shingle, seed).distinct().withColumnRenamed("doc_id", "th")
    rows = rows.join(again.join(lookup, "fp"), "th").where(field("doc_id").eqNullSafe(F.col("component_id")))
    first = rows.groupBy("component").agg(F.min("th").alias("th"))
    one = rows.join(first, ["component", "th"]).dropDuplicates(["component"])
    return alone.unionByName(one.select(*[field(c).alias(c) for c in docs.columns]))
