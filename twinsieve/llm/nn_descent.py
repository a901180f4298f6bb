"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy graph search.

Building (Dong, Moses & Li, WWW 2011) is a sequence of Spark joins.  Equal vectors
are one node.  Every node starts with the best of some windows of vectors that are
sorted alike under random hyperplanes.  A round joins the neighbour lists with
themselves: each node gathers its neighbours and a sample of the nodes that list it,
the members of such a neighbourhood are compared with each other (pairs that an
earlier round compared are skipped), and improvements go to the lists of both.  Rounds end
when few lists change.  However many nodes list one node, tasks hold at most about twice ``k``
members of its neighbourhood: every task cuts them to the first ``k`` before they are shuffled, as it does
offers to a node that it has many for, and offers are folded into the ``k`` best per node as they stream.
Entries of lists are handled as arrays, by sorting; no entry becomes a Python object but those of the lists kept.

A search keeps for each query a beam of the ``beam`` best nodes known.  A round expands its
best unexpanded nodes: joins fetch their neighbour lists, drop the nodes already seen,
fetch the rest's vectors and merge the similarities.  Queries that are rows of the table enter
at their own node.  Graph and beam use 16-bit copies of the unit vectors; the final
beam is scored in double precision on the original vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
and rows without id take no part; vectors of other dimension are never near; ties go to the
smaller id; repeated rows are candidates of each other only under different ids; with
fewer candidates than asked all are returned; other columns do not matter.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.cap_filters import unit, usable
from twinsieve.llm.common import Scratch

STATE = "id long, q binary, ids array<long>, sims array<float>, fresh array<boolean>"


def quantise(x: np.ndarray) -> bytes:
    """Unit vector -> 16-bit components scaled to their largest (the scale cancels in a cosine).

    8 bits are too few: among near copies (cosines 0.99 and above) their error hides the order."""
    return np.round(x / np.abs(x).max() * 32767).astype("<i2").tobytes()


def unit16(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype="<i2").reshape(len(rows), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(rows: list[bytes]) -> np.ndarray:
    """Cosines of all pairs of one small group; -2 where dimensions differ."""
    if len({len(r) for r in rows}) == 1:
        x = unit16(rows)
        return x @ x.T
    out = np.full((len(rows), len(rows)), -2, dtype=np.float32)
    size = np.array([len(r) for r in rows])
    for d in set(size.tolist()):
        at = np.flatnonzero(size == d)
        x = unit16([rows[i] for i in at])
        out[np.ix_(at, at)] = x @ x.T
    return out


def first_rows(edges: DataFrame, order: list, n: int) -> DataFrame:
    """The ``n`` first rows (c, m, ...) of every ``c`` by the columns ``order``, numbered from 1 in ``r``.  Spark cuts to them
    within every task that makes rows, before the shuffle (window group limit), so that the rows of a ``c`` that many others
    list meet in no task.  (Columns: an expression would be worked out anew for every comparison of a sort.)"""
    whole = Window.partitionBy("c").orderBy(*order)
    return edges.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= n)


def best_of(node: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best entries of every node (small numbers), each id once with its largest similarity: falling, ties by id."""
    if not len(node):
        return node, ids, sims
    high = node.astype(np.uint64) << np.uint64(32)
    key = high | np.unique(ids, return_inverse=True)[1].astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sims = np.maximum.reduceat(sims[order], at) + np.float32(0)  # one zero
    order = order[at]
    node, ids, high = node[order], ids[order], high[order]
    bits = sims.view(np.uint32)
    falling = np.where(bits >> np.uint32(31), bits, ~bits & np.uint32(0x7FFFFFFF))
    order = np.argsort(high | falling, kind="stable")
    node, ids, sims = node[order], ids[order], sims[order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    kept = rank < k
    return node[kept], ids[kept], sims[kept]


def folded(batches, k: int):
    """(id, q, ids of the first row, the ``k`` best of all) of each run of equal ids; holds a batch and ``k`` entries."""
    held = None  # the last run so far: id, q, ids of its first row, ids and similarities of its best
    for batch in batches:
        key = batch.column("id").to_numpy()
        if not len(key):
            continue
        run = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lists = batch.column("ids")
        node = np.repeat(run, np.diff(lists.offsets.to_numpy()))
        ids, sims = lists.flatten().to_numpy(), batch.column("sims").flatten().to_numpy().astype(np.float32, copy=False)
        heads = list(zip(key[first].tolist(), batch.column("q").take(first).to_pylist(), lists.take(first).to_pylist(), strict=True))
        if held is not None and held[0] == heads[0][0]:
            heads[0] = held[:3]
            node, ids, sims = np.concatenate([np.zeros(len(held[3]), dtype=node.dtype), node]), np.concatenate([held[3], ids]), np.concatenate([held[4], sims])
        elif held is not None:
            yield (*held[:3], list(zip(held[3].tolist(), held[4].tolist(), strict=True)))
        node, ids, sims = best_of(node, ids, sims, k)
        ends = np.searchsorted(node, np.arange(len(heads) + 1))
        held = (*heads[-1], ids[ends[-2] :], sims[ends[-2] :])
        flat_ids, flat_sims = ids.tolist(), sims.tolist()
        for head, a, b in zip(heads[:-1], ends.tolist(), ends[1:].tolist()):
            yield (*head, list(zip(flat_ids[a:b], flat_sims[a:b], strict=True)))
    if held is not None:
        yield (*held[:3], list(zip(held[3].tolist(), held[4].tolist(), strict=True)))


def whole_runs(batches, key: str):
    """Batches of a partition sorted by ``key`` in which no run of equal keys is split, and where their runs start and end."""
    import pyarrow as pa

    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy()
        ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        last = int(ends[-1]) if len(ends) else 0
        held = batch.slice(last)
        if last:
            yield batch.slice(0, last), [0, *ends.tolist()]
    if held is not None:
        yield held, [0, len(held)]


def vectors_of(column) -> np.ndarray | None:
    """The 16-bit vectors of a binary column as rows; None where dimensions differ."""
    sizes = np.unique(np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]))
    if len(sizes) != 1:
        return None
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], "<i2", len(column) * int(sizes[0]) // 2, int(start)).reshape(len(column), -1)


def units(column) -> np.ndarray | None:
    """Rows of a column of lists as unit vectors (see :func:`unit`); None where dimensions differ."""
    sizes = np.unique(np.diff(column.offsets.to_numpy()))
    if len(sizes) != 1:
        return None
    x = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def runs(batches, key: str, columns: list[str], most: int):
    """Rows of a partition sorted by ``key``, a run of equal keys at a time: (key, lists of the columns, ``most`` rows at most)."""
    held_key, held = None, [[] for _ in columns]
    for batch in batches:
        keys = batch.column(key).to_pylist()
        cols = [batch.column(c).to_pylist() for c in columns]
        at = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at]:
                if keys[at] != held_key:
                    if held_key is not None:
                        yield held_key, held
                    held_key, held = keys[at], [[] for _ in columns]
                for h, c in zip(held, cols, strict=True):
                    h.extend(c[at : min(i, at + most - len(h))])
                at = i
    if held_key is not None:
        yield held_key, held


def offers(to: np.ndarray, sizes: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int):
    """(id, ids, sims) rows, ``sizes`` entries each, as a batch; a node that gets many entries is left with its ``k`` best."""
    import pyarrow as pa

    node = np.unique(to, return_inverse=True)[1]
    many = (np.bincount(node, weights=sizes) > 8 * k)[node]
    if many.any():
        of = np.repeat(many, sizes)
        rows, best, s = best_of(np.repeat(node, sizes)[of], ids[of], sims[of], k)
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        names = np.empty(node.max() + 1, dtype=np.int64)
        names[node] = to
        to = np.concatenate([to[~many], names[rows[first]]])
        sizes = np.concatenate([sizes[~many], np.diff(np.append(first, len(rows)))])
        ids, sims = np.concatenate([ids[~of], best]), np.concatenate([sims[~of], s])
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(to, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(sims, pa.float32()))],
        names=["id", "ids", "sims"])


OFFER = "id long, ids array<long>, sims array<float>"
#: Entries of offers that a task gathers before it hands them on.
GATHERED = 1 << 18


def gathered(found, k: int):
    """The (to, sizes, ids, sims) of ``found`` as batches of about ``GATHERED`` entries."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[2])
        if n >= GATHERED:
            yield offers(*map(np.concatenate, zip(*held, strict=True)), k)
            held, n = [], 0
    if held:
        yield offers(*map(np.concatenate, zip(*held, strict=True)), k)


def _first_offers(nodes: DataFrame, parts: int, k: int, tables: int, window: int) -> DataFrame:
    """Windows of ``window`` vectors sorted by the signs of random projections, compared among themselves."""

    def codes(batches):
        import pyarrow as pa

        planes: dict = {}
        for batch in batches:
            q = batch.column("q")
            sizes = np.diff(np.frombuffer(q.buffers()[1], np.int32)[q.offset : q.offset + len(q) + 1])
            code = np.empty((len(q), tables), dtype=np.int64)
            for size in np.unique(sizes).tolist():
                d, at = size // 2, np.flatnonzero(sizes == size)
                if d not in planes:
                    planes[d] = np.random.default_rng((3, d)).normal(size=(d, tables * 32)).astype(np.float32)
                x = vectors_of(q.take(at)).astype(np.float32)
                code[at] = np.packbits((x @ planes[d]).reshape(len(at), tables, 32) > 0, axis=2).view(">u4").reshape(len(at), tables)
            each = np.repeat(np.arange(len(q)), tables)
            yield pa.RecordBatch.from_pydict({"t": pa.array(np.tile(np.arange(tables, dtype=np.int32), len(q))), "code": pa.array(code.ravel()),
                                              "id": batch.column("id").take(each), "q": q.take(each)})

    def windows(batches):
        ids, rows = np.empty(0, dtype=np.int64), []

        def best(ids, rows):
            s = cosines(rows)
            np.fill_diagonal(s, -3)
            n = min(k, len(ids) - 1)
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            near = np.take_along_axis(s, top, 1)
            ok = near > -2
            return ids, ok.sum(1), ids[top][ok], near[ok]

        for batch in batches:
            ids, rows = np.concatenate([ids, batch.column("id").to_numpy()]), rows + batch.column("q").to_pylist()
            at = 0
            while len(ids) - at > window:
                yield best(ids[at : at + window], rows[at : at + window])
                at += window // 2  # windows overlap by half
            ids, rows = ids[at:], rows[at:]
        if len(ids) > 1:
            yield best(ids, rows)

    def compare(batches):
        yield from gathered(windows(batches), k)

    coded = nodes.select("id", "q").mapInArrow(codes, "t int, code long, id long, q binary")
    return coded.repartitionByRange(parts, "t", "code", "id").sortWithinPartitions("t", "code", "id").mapInArrow(compare, OFFER)


def _merge(state: DataFrame, found: DataFrame, parts: int, k: int) -> DataFrame:
    """Each node's list with the offers to it: the ``k`` best, those not held before marked fresh."""
    both = state.select("id", F.lit(0).alias("kind"), "q", "ids", "sims").unionByName(
        found.select("id", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("q"), "ids", "sims"))

    def run(batches):
        import pyarrow as pa

        out = []

        def emit():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.int64())),
                 pa.array(cols[3], pa.list_(pa.float32())), pa.array(cols[4], pa.list_(pa.bool_()))], names=["id", "q", "ids", "sims", "fresh"])

        for node, q, ids, top in folded(batches, k):
            old = set(ids)
            out.append((node, q, [x for x, _ in top], [s for _, s in top], [x not in old for x, _ in top]))
            if len(out) == 4096:
                yield emit()
                out = []
        if out:
            yield emit()

    return both.repartition(parts, "id").sortWithinPartitions("id", "kind").mapInArrow(run, STATE)


def _neighbourhoods(state: DataFrame, parts: int, k: int, turn: int = 0) -> DataFrame:
    """(c, kind, m, q, least, fresh): the members of every node's neighbourhood, sorted; kind 1: a sample, another
    one each ``turn``, of the nodes that list it, one more than ``k`` where there are more."""
    edges = state.select("id", F.explode(F.arrays_zip("ids", "fresh")).alias("e"))
    back = edges.select(F.col("e.ids").alias("c"), F.lit(1).alias("kind"), F.col("id").alias("m"), F.col("e.fresh").alias("fresh"),
                        F.xxhash64(F.lit(turn), "e.ids", "id").alias("h"))
    target = state.select(F.col("id").alias("m"), "q", F.coalesce(F.try_element_at("sims", F.lit(-1)), F.lit(-2.0)).cast("float").alias("least"))
    both = first_rows(back, ["h", "m"], k + 1).drop("h").unionByName(
        edges.select(F.col("id").alias("c"), F.lit(0).alias("kind"), F.col("e.ids").alias("m"), F.col("e.fresh").alias("fresh"), F.lit(0).alias("r")))
    return both.join(target, "m").select("c", "kind", "m", "q", "least", "fresh", "r").repartition(parts, "c").sortWithinPartitions("c", "r")


def _local_joins(state: DataFrame, parts: int, k: int, turn: int = 0) -> DataFrame:
    def found(batches):
        for batch, ends in whole_runs(batches, "c"):
            kinds, ms, leasts, freshs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "m", "least", "fresh"))
            q = batch.column("q")
            x = vectors_of(q)
            if x is not None:
                x = x.astype(np.float32)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
            for lo, hi in zip(ends, ends[1:]):
                # the neighbours, and a hashed sample of the nodes that list this one
                stop = int((kinds[lo:hi] == 0).sum()) + k
                at = lo + np.sort(np.unique(ms[lo : min(hi, lo + stop)], return_index=True)[1])
                # Of more nodes than the sample takes, earlier rounds may have left these out: all pairs with them count as new.
                new = freshs[at] | (kinds[at] == 1) if hi - lo > stop else freshs[at]
                if len(at) < 2 or not new.any():
                    continue
                s = cosines(q.take(at).to_pylist()) if x is None else x[at] @ x[at].T
                better = s > leasts[at][:, None]
                better &= new[:, None] | new[None, :]
                np.fill_diagonal(better, False)
                sizes, m = better.sum(1), ms[at]
                some = sizes > 0
                yield m[some], sizes[some], m[np.nonzero(better)[1]], s[better]

    def run(batches):
        yield from gathered(found(batches), k)

    return _neighbourhoods(state, parts, k, turn).mapInArrow(run, OFFER)


def build_graph(nodes: DataFrame, scratch: Scratch, k: int = 32, rounds: int | None = None, settle: float = 0.01,
                tables: int = 6, window: int = 128) -> DataFrame:
    """Neighbour lists (id, q, ids, sims, fresh) of ``nodes`` (id, q): NN-descent until at most ``settle`` of the entries
    change (lists only get better, so that comes), or for ``rounds`` if given."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    empty = nodes.select("id", "q", F.expr("cast(array() as array<long>)").alias("ids"), F.expr("cast(array() as array<float>)").alias("sims"),
                         F.expr("cast(array() as array<boolean>)").alias("fresh"))
    state, path = scratch.save_replacing(_merge(empty, _first_offers(nodes, parts, k, tables, window), parts, k), "lists", None)
    for turn in count() if rounds is None else range(rounds):
        state, path = scratch.save_replacing(_merge(state, _local_joins(state, parts, k, turn), parts, k), "lists", path)
        changed, entries = state.agg(F.sum(F.expr("size(filter(fresh, x -> x))")), F.sum(F.size("ids"))).first()
        if not entries or changed <= settle * entries:
            break
    return state


def adjacency(state: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """(id, nb): each node's neighbours and up to 2k of the nodes that list it, those that list it first before others.

    A node that few others list is reached through the nodes it lists: its nearest ones keep the way back to it."""
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = state.select("id", F.posexplode("ids").alias("pos", "o"))
    back = edges.select(F.col("o").alias("c"), F.lit(1).alias("kind"), "pos", F.col("id").alias("m")).withColumn("h", F.xxhash64("c", "m"))
    both = edges.select(F.col("id").alias("c"), F.lit(0).alias("kind"), F.col("o").alias("m"), F.col("pos").alias("r")).unionByName(
        first_rows(back, ["pos", "h", "m"], 2 * k).drop("pos", "h"))

    def run(batches):
        import pyarrow as pa

        def emit():
            return pa.RecordBatch.from_pydict({"id": pa.array([c for c, _ in out], pa.int64()), "nb": pa.array([m for _, m in out], pa.list_(pa.int64()))})

        out = []
        for c, (m,) in runs(batches, "c", ["m"], 3 * k):
            out.append((c, list(dict.fromkeys(m))))
            if len(out) == 4096:
                yield emit()
                out = []
        if out:
            yield emit()

    ordered = both.repartition(parts, "c").sortWithinPartitions("c", "kind", "r")
    return scratch.save(ordered.mapInArrow(run, "id long, nb array<long>"), "graph")


SEARCH = "qid long, q binary, ids array<long>, sims array<float>, open array<boolean>, seen array<long>, frontier array<long>"


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, scratch: Scratch, beam: int = 64, expand: int = 32) -> DataFrame:
    """Beams (qid, ids, sims) of ``queries`` (qid, q, frontier: the nodes to enter at): greedy search until no beam
    holds an unexpanded node."""
    state, path = scratch.save_replacing(
        queries.select("qid", "q", F.expr("cast(array() as array<long>)").alias("ids"), F.expr("cast(array() as array<float>)").alias("sims"),
                       F.expr("cast(array() as array<boolean>)").alias("open"), F.expr("cast(array() as array<long>)").alias("seen"), "frontier"), "beams", None)

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = vectors_of(batch.column("q")), vectors_of(batch.column("x"))
            if a is not None and b is not None and a.shape == b.shape:
                a, b = a.astype(np.float32), b.astype(np.float32)
                s = (a / np.linalg.norm(a, axis=1, keepdims=True) * (b / np.linalg.norm(b, axis=1, keepdims=True))).sum(1)
            else:
                a, b = batch.column("q").to_pylist(), batch.column("x").to_pylist()
                s = np.full(len(a), -2, dtype=np.float32)
                same = [i for i in range(len(a)) if len(a[i]) == len(b[i])]
                for d in {len(a[i]) for i in same}:
                    at = [i for i in same if len(a[i]) == d]
                    s[at] = (unit16([a[i] for i in at]) * unit16([b[i] for i in at])).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("m"), pa.array(s)], names=["qid", "m", "s"])

    def merge(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for q, v, ids, sims, open_, seen, new, news in zip(*(batch.column(c).to_pylist() for c in
                                                                 ("qid", "q", "ids", "sims", "open", "seen", "new", "news")), strict=True):
                left = [(s, i, o) for i, s, o in zip(ids, sims, open_, strict=True)]
                left += [(s, i, True) for i, s in zip(new or [], news or [], strict=True) if s > -2]
                left = sorted(left, key=lambda x: (-x[0], x[1]))[:beam]
                chosen = {i for _, i in [(s, i) for s, i, o in left if o][:expand]}
                out.append((q, v, [i for _, i, _ in left], [s for s, _, _ in left], [o and i not in chosen for _, i, o in left],
                            seen + (new or []), sorted(chosen)))
            if out:
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                                 names=["qid", "q", "ids", "sims", "open", "seen", "frontier"])

    while True:
        ahead = state.select("qid", F.explode("frontier").alias("id"))
        if not ahead.limit(1).count():
            return state.select("qid", "ids", "sims")
        met = ahead.join(graph, "id").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("nb"))).alias("met"))  # expand x 3k at most
        fresh = met.join(state.select("qid", "q", "seen"), "qid").select("qid", "q", F.explode(F.array_except("met", "seen")).alias("m"))
        pairs = fresh.join(nodes.select(F.col("id").alias("m"), F.col("q").alias("x")), "m")
        scored = pairs.select("qid", "m", "q", "x").mapInArrow(compare, "qid long, m long, s float")
        gathered = scored.groupBy("qid").agg(F.collect_list("m").alias("new"), F.collect_list("s").alias("news"))
        state, path = scratch.save_replacing(state.drop("frontier").join(gathered, "qid", "left").mapInArrow(merge, SEARCH), "beams", path)


def nearest(vectors: DataFrame, is_query, top: int = 5, k: int = 32, rounds: int | None = None, beam: int = 128,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows found for every row where ``is_query(id)`` holds."""
    scratch = Scratch(vectors.sparkSession, "neighbours")
    good = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    keys = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    keyed = good.select("id", *keys).distinct()
    # A class of equal vectors names its top + 1 smallest ids: enough once a query's own is left out.
    low = Window.partitionBy("h1", "h2", "salt").orderBy("id")
    least = (keyed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(low)).where(F.col("r") <= top + 1)
             .groupBy("h1", "h2").agg(F.slice(F.sort_array(F.collect_list("id")), 1, top + 1).alias("rows")))
    first = good.select("v", *keys).groupBy("h1", "h2").agg(F.first("v").alias("v"))
    classes = scratch.save(first.join(least, ["h1", "h2"]).withColumn("cid", F.monotonically_increasing_id()), "classes")

    def shrink(batches):
        import pyarrow as pa

        for batch in batches:
            x = units(batch.column("v"))
            rows = x if x is not None else [unit(v) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array([quantise(v) for v in rows], pa.binary())], names=["id", "q"])

    nodes = scratch.save(classes.select("cid", "v").mapInArrow(shrink, "id long, q binary"), "nodes")
    lists = build_graph(nodes, scratch, k, rounds)
    graph = adjacency(lists, scratch, k)
    asking = keyed.where(is_query(F.col("id"))).join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select(F.col("id").alias("query_id"), "cid")
    asking = scratch.save(asking, "queries")
    start = asking.select("cid").distinct().join(nodes.withColumnRenamed("id", "cid"), "cid").select(F.col("cid").alias("qid"), "q", F.array("cid").alias("frontier"))
    beams = search(start, graph, nodes, scratch, beam)
    close = beams.select("qid", F.explode("ids").alias("cid")).unionByName(beams.select("qid", F.col("qid").alias("cid"))).distinct()
    exact = (
        close.join(classes.select("cid", "v", "rows"), "cid").withColumnRenamed("v", "x")
        .join(classes.select(F.col("cid").alias("qid"), "v"), "qid").select("qid", "v", "x", "rows")
    )

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = units(batch.column("v")), units(batch.column("x"))
            if a is not None and b is not None and a.shape == b.shape:
                s = np.einsum("ij,ij->i", a, b)
            else:
                s = []
                for a, b in zip(batch.column("v").to_pylist(), batch.column("x").to_pylist(), strict=True):
                    s.append(float(unit(a) @ unit(b)) if len(a) == len(b) else None)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("rows"), pa.array(s, pa.float64())], names=["qid", "rows", "score"])

    scored = exact.mapInArrow(measure, "qid long, rows array<long>, score double").where("score is not null")
    ranked = scored.select("qid", F.explode("rows").alias("id"), "score").groupBy("qid").agg(  # (beam + 1) x (top + 1) rows a group
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, top + 1).alias("best"))
    ranked = scratch.save(ranked, "ranked")
    return (
        asking.join(ranked.withColumnRenamed("qid", "cid"), "cid")
        .select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, top)).alias("pos", "x"))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), (-F.col("x.s")).alias("score"))
    )
