"""Embedding near-duplicates by spherical-cap filters.

Filter directions form a structured random product code: after a random rotation
a vector is cut into ``BLOCKS`` blocks, each with a code of B random unit directions;
every combination of one direction a block is a filter, so B**BLOCKS directions
come from B * BLOCKS stored ones.  A vector joins each filter whose cap it lies in.  The
cap's threshold follows the vector - the score of its ``lists``-th best filter -
because a fixed one leaves vectors with unlucky blocks in no cap at all (measured:
half of the pairs at cosine 0.95 lost).  The list is decoded from the block scores:
of the sums of two ranked lists only those that can be among the best are formed.
``rotations`` codes are used, more of them for larger tables, where caps are tighter.
Vectors that share a filter are compared exactly; of 100,000 random pairs of 64 dimensions
at cosine exactly 0.95, with 20 lists, those missed are 4 at the filters of 10^5 vectors
(2 rotations), none at 10^6 (3), none at 10^7 and 1 at 10^8 (4), none at 10^9 (5; not measured
beyond).  With 2 rotations 25 were missed at 10^6, and of 8,000 pairs 46 at 10^8.

The number of filters follows the number of distinct vectors, so that a vector
lies in about ``lists`` caps and a cap holds about ``bucket`` unrelated vectors at any
size.  A cap held by more than ``block`` vectors (a cloud of near copies) is cut into
chunks and compared chunk against chunk, so no task holds a whole group.

A pair that shares several caps is counted in the first of them; tasks emit each
vector's number of links and a spanning forest of the links they see, never the
pairs.  Equal vectors are collapsed to one class before anything else.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing (their own component, kept); vectors of different
dimension do not link; rows that repeat a vector are separate vectors and link with
each other; a null ``vec_id`` never names a component; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import Scratch
from twinsieve.llm.components import components

BLOCKS = 4
# A rotation more beyond each of these sizes, the largest at which the number before it was measured to do.
ROTATE = (16, 29, 89)


def usable(emb: Column) -> Column:
    """Not null, not zero, all components present and finite."""
    bad = F.exists(emb, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(emb.isNotNull() & ~bad & F.exists(emb, lambda x: x != 0), F.lit(False))


def top_sums(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, base: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest sums a[i] + b[j] of each row (both sorted, falling) and their numbers ia[i] * base + ib[j].

    The sum of ranks i and j is beaten by (i + 1)(j + 1) - 1 others, so only ranks with (i + 1)(j + 1) <= k are formed."""
    i, j = (np.array(v) for v in zip(*((i, j) for i in range(a.shape[1]) for j in range(b.shape[1]) if (i + 1) * (j + 1) <= k), strict=True))
    s = a[:, i] + b[:, j]
    o = np.argsort(-s, axis=1, kind="stable")[:, :k]
    row = np.arange(len(a))[:, None]
    return np.take_along_axis(s, o, 1), ia[row, i[o]] * base + ib[row, j[o]]


class ProductCode:
    """The filters of one dimension and rotation: ``BLOCKS`` codes of ``size`` unit directions."""

    def __init__(self, dim: int, size: int, seed: int):
        rng = np.random.default_rng((seed, dim, size))
        q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
        self.rotation, self.size = q * np.sign(np.diag(r)), size
        self.cuts = np.linspace(0, dim, BLOCKS + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            c = rng.normal(size=(size, b - a))
            self.codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12))

    def decode(self, x: np.ndarray, lists: int) -> np.ndarray:
        """The numbers of the filters whose cap each row of ``x`` lies in: (len(x), lists), unordered."""
        y, level = x @ self.rotation, []
        for a, b, c in zip(self.cuts, self.cuts[1:], self.codes, strict=False):
            v = y[:, a:b] @ c.T
            o = np.argsort(-v, axis=1, kind="stable")[:, :lists]
            level.append((np.take_along_axis(v, o, 1), o.astype(np.int64)))
        left = top_sums(*level[0], *level[1], self.size, lists)
        right = top_sums(*level[2], *level[3], self.size, lists)
        return top_sums(*left, *right, self.size**2, lists)[1]


def rotations_for(size: int) -> int:
    """Codes needed at ``size`` directions a block: caps tighten as the filters grow, so larger tables take more."""
    return 2 + sum(size > s for s in ROTATE)


def unit(values) -> np.ndarray:
    x = np.array(values, dtype=np.float64)
    x = x / np.abs(x).max()  # very large or small components do not overflow the norm
    return x / np.linalg.norm(x)


def forest(near: np.ndarray) -> np.ndarray:
    """For each node of a symmetric adjacency the smallest node of its component."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def near_duplicates(vectors: DataFrame, min_cosine: float = 0.95, lists: int = 20, rotations: int | None = None, bucket: int = 32, block: int = 2048,
                    id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "caps")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    good = rows.where(usable(F.col("v")))
    keys = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    members = scratch.save(good.select("id", *keys), "members")
    classes = (
        good.select("id", "v", *keys).groupBy("h1", "h2").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("v").alias("v"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = scratch.save(classes, "classes")
    total = classes.count()
    size = max(4, round((lists * max(1, total) / bucket) ** (1 / BLOCKS) + 0.5))
    rotations = rotations or rotations_for(size)
    number = "<i4" if rotations * size**BLOCKS < 1 << 31 else "<i8"
    wide = "double" in vectors.schema[vec_col].dataType.simpleString()

    def decoded(batch, codes):
        """Unit vectors of a batch and the sorted filter numbers of each."""
        x = [unit(v) for v in batch.column("v").to_pylist()]
        dims = np.array([len(v) for v in x])
        found = np.empty((len(x), 0), dtype=np.int64)
        for d in sorted(set(dims.tolist())):
            if d not in codes:
                codes[d] = [ProductCode(d, size, 11 + r) for r in range(rotations)]
            at = np.flatnonzero(dims == d)
            rows_ = np.array([x[i] for i in at])
            own = np.sort(np.concatenate([c.decode(rows_, lists) + r * size**BLOCKS for r, c in enumerate(codes[d])], axis=1), axis=1)
            if not found.shape[1]:
                found = np.empty((len(x), own.shape[1]), dtype=np.int64)
            found[at] = own
        return found

    def numbers(batches):
        import pyarrow as pa

        codes: dict = {}
        for batch in batches:
            if batch.num_rows:
                f, n = np.unique(decoded(batch, codes), return_counts=True)
                yield pa.RecordBatch.from_pydict({"f": pa.array(f), "n": pa.array(n.astype(np.int64))})

    def decode(batches):
        import pyarrow as pa

        codes: dict = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # bounded batches: every row repeats its vector
                batch = whole.slice(at, 256)
                found = decoded(batch, codes)
                k = found.shape[1]
                rep = pa.array(np.repeat(np.arange(len(found)), k))
                raw = [np.array(v, dtype="<f8" if wide else "<f4").tobytes() for v in batch.column("v").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "f": pa.array(found.ravel()), "cid": batch.column("cid").take(rep), "n": batch.column("n").take(rep),
                    "x": pa.array(raw, pa.binary()).take(rep), "all": pa.array([v.astype(number).tobytes() for v in found], pa.binary()).take(rep)})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = classes.select("cid", "n", "v")
    caps = spread.mapInArrow(decode, "f long, cid long, n long, x binary, all binary")
    held = spread.mapInArrow(numbers, "f long, n long").groupBy("f").agg(F.sum("n").alias("held"))
    chunks = scratch.save(held.where(F.col("held") > block).select("f", F.ceil(F.col("held") / (block / 2)).cast("int").alias("c")), "chunks")
    placed = caps.join(chunks, "f", "left").withColumn("mine", F.when(F.col("c").isNotNull(), F.pmod(F.xxhash64("cid"), F.col("c"))).otherwise(0))
    others = F.when(F.col("c").isNotNull(), F.expr("transform(sequence(0, c - 1), k -> named_struct('i', least(cast(mine as int), k), 'j', greatest(cast(mine as int), k)))")
                    ).otherwise(F.expr("array(named_struct('i', 0, 'j', 0))"))
    placed = placed.select("f", F.col("mine").cast("int").alias("mine"), "cid", "n", "x", "all", F.inline(others))
    grouped = placed.repartition(parts, "f", "i", "j").sortWithinPartitions("f", "i", "j", "cid")

    def compare(key, cid, n, mine, x, lists_):
        f, i, j = key
        if len(cid) < 2:
            return [], []
        sizes = {len(v) for v in x}
        links, edges = [], []
        for d in sizes:  # a filter number may be shared by vectors of different dimension
            at = np.array([k for k, v in enumerate(x) if len(v) == d])
            if len(at) < 2:
                continue
            m = np.array([unit(np.frombuffer(x[k], dtype="<f8" if wide else "<f4")) for k in at])
            near = m @ m.T >= min_cosine
            np.fill_diagonal(near, False)
            own = np.array([mine[k] for k in at])
            if i != j:
                near &= own[:, None] != own[None, :]
            a, b = np.nonzero(np.triu(near))
            if not len(a):
                continue
            label = forest(near)
            edges += [(cid[at[k]], cid[at[label[k]]]) for k in np.flatnonzero(label != np.arange(len(at)))]
            # A pair counts in the first filter it shares: no smaller one holds both.
            own = [np.frombuffer(lists_[at[k]], dtype=number) for k in range(len(at))]
            flat = np.concatenate([v[: np.searchsorted(v, f)] for v in own])
            who = np.repeat(np.arange(len(at)), [np.searchsorted(v, f) for v in own])
            _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
            twice = count > 1
            holds = np.zeros((len(at), int(twice.sum())), dtype=np.float32)
            use = twice[code]
            holds[who[use], (np.cumsum(twice) - 1)[code[use]]] = 1
            first = (holds @ holds.T)[a, b] == 0
            weight = np.array([n[k] for k in at], dtype=np.int64)
            sums = np.zeros(len(at), dtype=np.int64)
            np.add.at(sums, a[first], weight[b[first]])
            np.add.at(sums, b[first], weight[a[first]])
            links += [(cid[at[k]], int(sums[k])) for k in np.flatnonzero(sums)]
        return links, edges

    def meet(batches):
        import pyarrow as pa

        def emit(links, edges):
            return pa.RecordBatch.from_pydict({
                "u": pa.array([u for u, _ in links] + [u for u, _ in edges], pa.int64()),
                "links": pa.array([k for _, k in links] + [None] * len(edges), pa.int64()),
                "v": pa.array([None] * len(links) + [v for _, v in edges], pa.int64())})

        key, held = None, ([], [], [], [], [])
        links, edges = [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("f", "i", "j", "cid", "n", "mine", "x", "all")]
            for f, i, j, *row in zip(*cols, strict=True):
                if (f, i, j) != key:
                    if key is not None:
                        a, b = compare(key, *held)
                        links += a
                        edges += b
                    key, held = (f, i, j), ([], [], [], [], [])
                for h, v in zip(held, row, strict=True):
                    h.append(v)
            if links or edges:
                yield emit(links, edges)
                links, edges = [], []
        if key is not None:
            links, edges = compare(key, *held)
            if links or edges:
                yield emit(links, edges)

    met = scratch.save(grouped.mapInArrow(meet, "u long, links long, v long"), "met")
    counts = met.where("links is not null").groupBy("u").agg(F.sum("links").alias("links"))
    found = components(met.where("v is not null").select("u", "v"), scratch)
    named = (
        classes.select("cid", "h1", "h2", "low", "n")
        .join(counts.withColumnRenamed("u", "cid"), "cid", "left").join(found.withColumnRenamed("node", "cid"), "cid", "left")
        .select("h1", "h2", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    )
    named = scratch.save(named, "named")
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    lookup = scratch.save(named.join(least, "component").select("h1", "h2", "n_links", "component_id"), "lookup")
    linked = members.join(lookup, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("v"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
