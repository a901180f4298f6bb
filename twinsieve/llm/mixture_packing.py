"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of tokens (its documents by ``doc_id``).  A window of
``window`` tokens takes from each active queue its quantum, ``window x target
share``; fractions are carried as deficits to the next window, so the tokens
served by queue *s* after *k* windows stay within one token of ``k x quantum``.
With integer shares the deficit state has a closed form in *k* (cumulative
quanta rounded at their running boundaries), so the state carried into any
window - and into any partition - is known without replaying the earlier ones:
tasks cut their own documents independently and no token stream passes through
one task.  A queue that runs dry ends a phase; the drained window is filled from
the others and their shares are renormalised.  The last partial window is cut at
powers of two, so no sequence needs padding.

Steps: range-partition the documents by (source, doc_id); each partition
tokenizes and writes its ids with running positions; the per-(partition, source)
totals - a summary of at most partitions + sources rows - give queue offsets and
the phase table; each task cuts its documents.

Queues are bounded: a source with less than 1/256 of all tokens, whose quantum is
under ``window / 256`` tokens, joins the pooled queue, so there are at most 257
whatever the number of sources.  Inside the pool every source still gets its own
share of every window: it is served in lumps of ``window / 256`` tokens (its deficit
runs on until a lump is due), and lump *p* of the pool's documents, in order of
(source, doc_id), is served at place ``p x step mod lumps``, with a step near the
golden section.  That spreads any run of lumps evenly over the pool (three-distance
theorem), so a source is a few lumps at most from its target after any window, and a
task knows the places of its documents from their position alone.

Defined results: null text is empty (one terminator token); null source counts
as ''; null ``doc_id`` sorts first in its queue; repeated rows are packed as
often as they occur; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm import tokens
from twinsieve.llm.common import Scratch

#: Shares are integers out of this (k x window x SHARES stays within 63 bits up to 10^14 tokens).
SHARES = 1 << 16
POOL_BELOW = 1 / 256
#: Tokens of a pooled document placed at a time.
BLOCK = 1 << 18


def integer_shares(weights: list[float]) -> list[int]:
    """``weights`` as integers that add up to SHARES (largest remainders, ties to the earlier)."""
    total = sum(weights)
    exact = [w * SHARES / total for w in weights]
    out = [int(x) for x in exact]
    for i in sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))[: SHARES - sum(out)]:
        out[i] += 1
    return out


def quotients(a: int, b: int) -> int:
    """Sum of the partial quotients of a / b: it bounds how unevenly multiples of ``a`` lie modulo ``b``."""
    out = 0
    while b:
        out, a, b = out + a // b, b, a % b
    return out


@dataclass
class Interleave:
    """The order in which the pooled queue serves its ``tokens``: full lumps dealt out evenly, the rest last."""

    tokens: int
    lump: int

    def __post_init__(self):
        self.slots = self.tokens // self.lump
        near = int(self.slots * (math.sqrt(5) - 1) / 2)
        steps = [a for a in range(max(1, near - 100), near + 101) if math.gcd(a, self.slots) == 1]
        self.step = min(steps, key=lambda a: (quotients(a, self.slots), a), default=1)

    def places(self, at: int, n: int) -> np.ndarray:
        """Places in the pooled queue of the tokens [at, at + n) of its documents."""
        t = np.arange(at, at + n, dtype=np.int64)
        if not self.slots:
            return t
        first = at // self.lump
        lump = t // self.lump
        # In two digits: no product leaves 63 bits.
        high, low = np.divmod(lump - first, 4096)
        slot = (first * self.step % self.slots + high * (self.step * 4096 % self.slots) % self.slots + low * self.step) % self.slots
        return np.where(lump < self.slots, slot * self.lump + t % self.lump, t)


@dataclass
class Phase:
    """``windows`` windows from ``first`` on; ``base``: tokens served before, by queue.

    Regular phases have cumulative ``shares``; a single drained window has its cumulative ``takes``."""

    first: int
    windows: int
    base: list[int]
    shares: list[int] | None = None
    takes: list[int] | None = None

    def boundaries(self, x: np.ndarray, window: int) -> np.ndarray:
        """Tokens taken by the queues before each queue after ``x`` windows of the phase: (len(x), queues + 1)."""
        if self.takes is not None:
            return x[:, None] * np.array(self.takes, dtype=np.int64)[None, :]
        return x[:, None] * np.int64(window) * np.array(self.shares, dtype=np.int64)[None, :] // SHARES


@dataclass
class Schedule:
    """The whole round-robin as at most two phases for each queue."""

    window: int
    phases: list[Phase] = field(default_factory=list)
    full: int = 0
    tail: int = 0

    @classmethod
    def plan(cls, supply: list[int], weights: list[float], window: int) -> Schedule:
        self, left = cls(window), list(supply)
        n = len(left)
        while sum(left) >= window:
            active = [w if r > 0 else 0.0 for w, r in zip(weights, left, strict=True)]
            if not any(active):
                active = [float(r > 0) for r in left]
            m = integer_shares(active)
            cum = [0, *np.cumsum(m).tolist()]
            served = [s - r for s, r in zip(supply, left, strict=True)]
            taken = lambda x, cum=cum: [x * window * cum[i + 1] // SHARES - x * window * cum[i] // SHARES for i in range(n)]
            lo, hi = 0, sum(left) // window
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if all(t <= r for t, r in zip(taken(mid), left, strict=True)) else (lo, mid - 1)
            if lo:
                self.phases.append(Phase(self.full, lo, served, shares=cum))
                self.full += lo
                left = [r - t for r, t in zip(left, taken(lo), strict=True)]
            if sum(left) < window:
                break
            # The next window drains a queue: the others make up for what it lacks.
            quanta = [b - a for a, b in zip(taken(lo), taken(lo + 1), strict=True)]
            take = [min(q, r) for q, r in zip(quanta, left, strict=True)]
            for i in sorted(range(n), key=lambda i: (take[i] - left[i], i)):
                take[i] += min(window - sum(take), left[i] - take[i])
            self._single(take, [s - r for s, r in zip(supply, left, strict=True)])
            self.full += 1
            left = [r - t for r, t in zip(left, take, strict=True)]
        self.tail = sum(left)
        if self.tail:
            self._single(left, [s - r for s, r in zip(supply, left, strict=True)])
        return self

    def _single(self, take: list[int], served: list[int]) -> None:
        self.phases.append(Phase(self.full, 1, served, takes=[0, *np.cumsum(take).tolist()]))

    def cut(self, queue: int, start: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start within the stretch, sequence, offset) of the pieces of queue positions [start, start + length)."""
        out = []
        for p in self.phases:
            a, b = start - p.base[queue], start + length - p.base[queue]
            if b <= 0:
                break
            if p.shares is None:
                lo, hi = 0, 1
            else:
                m = p.shares[queue + 1] - p.shares[queue]
                if not m:
                    continue
                slack = 2 + -(-SHARES // (self.window * m))
                lo = min(p.windows, max(0, a * SHARES // (self.window * m) - slack))
                hi = min(p.windows, b * SHARES // (self.window * m) + slack)
            x = np.arange(lo, hi + 1, dtype=np.int64)
            ends = p.boundaries(x, self.window)
            own = ends[:, queue + 1] - ends[:, queue]
            begin, end = np.maximum(own[:-1], a), np.minimum(own[1:], b)
            k = np.flatnonzero(begin < end)
            if not len(k):
                continue
            at = (ends[k + 1, queue] - ends[k, queue]) + begin[k] - own[k]
            seq = p.first + x[k]
            if p.first == self.full:  # the tail: sequences of powers of two
                s, o, q, pos = int(begin[k[0]]), int(at[0]), self.full, 0
                e, pieces = int(end[k[0]]), []
                for size in (1 << i for i in reversed(range(self.tail.bit_length())) if self.tail >> i & 1):
                    f, t = max(o, pos), min(o + e - s, pos + size)
                    if f < t:
                        pieces.append((s + f - o, q, f - pos))
                    pos, q = pos + size, q + 1
                out.append(tuple(np.array(v, dtype=np.int64) for v in zip(*((f - a, q, o) for f, q, o in pieces), strict=True)))
            else:
                out.append((begin[k] - a, seq, at))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(v) for v in zip(*out, strict=True))

    def locate(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of single places of the first queue, whose part opens every regular window."""
        seq, off = np.empty_like(place), np.empty_like(place)
        for p in self.phases:
            got = np.flatnonzero(place >= p.base[0])  # later phases write over what is theirs
            y = place[got] - p.base[0]
            if p.shares is not None:
                per = self.window * p.shares[1]
                if not per:
                    continue
                k = ((y + 1) * SHARES - 1) // per
                seq[got], off[got] = p.first + k, y - k * per // SHARES
            elif p.first == self.full:
                sizes = [1 << i for i in reversed(range(self.tail.bit_length())) if self.tail >> i & 1]
                begin = np.concatenate([[0], np.cumsum(sizes)])
                k = np.searchsorted(begin, y, side="right") - 1
                seq[got], off[got] = p.first + k, y - begin[k]
            else:
                seq[got], off[got] = p.first, y
        return seq, off

    def cut_pool(self, pool: Interleave, at: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`cut` for a stretch of the pooled queue's documents, in blocks of bounded size."""
        out = []
        for block in range(0, length, BLOCK):
            seq, off = self.locate(pool.places(at + block, min(BLOCK, length - block)))
            new = np.ones(len(seq), dtype=bool)
            new[1:] = (seq[1:] != seq[:-1]) | (off[1:] != off[:-1] + 1)
            k = np.flatnonzero(new)
            out.append((k + block, seq[k], off[k]))
        return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def tokenize(docs: DataFrame, scratch: Scratch, tokenizer: dict | None = None, end_id: int = 0) -> DataFrame:
    """Documents in queue order with ids and running positions, written once: (pid, src, doc_id, local_start, n, ids)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), "doc_id", "text")
        .repartitionByRange(parts, "src", "doc_id")
        .sortWithinPartitions("src", "doc_id", "text")
        .withColumn("pid", F.spark_partition_id())
    )

    def encode(batches):
        import pyarrow as pa

        tok = tokens.byte_bpe(**(tokenizer or {}))
        end, width = np.array([end_id], dtype=tok.dtype).tobytes(), tok.dtype.itemsize
        at: dict[str, int] = {}
        for batch in batches:
            texts, src = batch.column("text"), batch.column("src").to_pylist()
            ids = [tok.encode(t.as_py() or "") + end for t in texts]
            n, starts = [len(x) // width for x in ids], []
            for s, k in zip(src, n, strict=True):
                if s not in at:
                    at = {s: 0}  # sorted by source: only the current one runs on
                starts.append(at[s])
                at[s] += k
            yield pa.RecordBatch.from_arrays(
                [batch.column("pid"), batch.column("src"), batch.column("doc_id"), pa.array(starts, pa.int64()),
                 pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                names=["pid", "src", "doc_id", "local_start", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scratch.save(ordered.mapInArrow(encode, f"pid int, src string, doc_id {kind}, local_start long, n long, ids binary"), "tokens")


@dataclass
class Packed:
    """The token table, each document's place in its queue, and the schedule that cuts it."""

    placed: DataFrame
    schedule: Schedule
    pool: Interleave
    kind: str

    def pieces(self, with_ids: bool = False) -> DataFrame:
        """One row per piece; ``with_ids`` adds its ids (little-endian unsigned 32-bit)."""
        schedule, pool = self.schedule, self.pool

        def cut(batches):
            import pyarrow as pa

            for batch in batches:
                row, parts, crc, ids_out = [], [], [], []
                queue, at, length, ids = (batch.column(c).to_pylist() for c in ("queue", "at", "n", "ids"))
                for i, (q, a, n, x) in enumerate(zip(queue, at, length, ids, strict=True)):
                    wide = np.frombuffer(x, dtype=f"<u{len(x) // n}").astype("<u4").tobytes()
                    start, seq, off = schedule.cut(q, a, n) if q else schedule.cut_pool(pool, a, n)
                    stop = np.append(start[1:], n)
                    parts.append((start, stop - start, np.full(len(start), n, dtype=np.int64), seq, off))
                    row.append(np.full(len(start), i, dtype=np.int64))
                    raw = [wide[4 * f : 4 * t] for f, t in zip(start.tolist(), stop.tolist(), strict=True)]
                    crc.extend(map(zlib.crc32, raw))
                    if with_ids:
                        ids_out.extend(raw)
                if not row:
                    continue
                start, size, total, seq, off = (np.concatenate(v) for v in zip(*parts, strict=True))
                doc = batch.column("doc_id").take(pa.array(np.concatenate(row)))
                columns = {"doc_id": doc, "start": pa.array(start), "length": pa.array(size), "ids_crc32": pa.array(crc, pa.int64()),
                           "doc_tokens": pa.array(total), "sequence_id": pa.array(seq), "offset": pa.array(off)}
                if with_ids:
                    columns["ids"] = pa.array(ids_out, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

        schema = f"doc_id {self.kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        return self.placed.mapInArrow(cut, schema + ", ids binary" * with_ids)

    def sequences(self, pad_id: int = 0) -> DataFrame:
        """The packed sequences: (sequence_id, n_tokens, ids, padding); a group holds at most ``window`` tokens."""
        window = self.schedule.window

        def build(batches):
            import pyarrow as pa

            for batch in batches:
                out, pad = [], []
                for parts in batch.column("parts").to_pylist():
                    x = np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4")
                    short = 0 if len(x) & (len(x) - 1) == 0 else window - len(x)
                    out.append(np.concatenate([x, np.full(short, pad_id, dtype="<u4")]).astype(np.int32))
                    pad.append(short)
                yield pa.RecordBatch.from_pydict({
                    "sequence_id": batch.column("sequence_id"), "n_tokens": batch.column("n_tokens"),
                    "ids": pa.array([x.tolist() for x in out], pa.list_(pa.int32())), "padding": pa.array(pad, pa.int32())})

        grouped = self.pieces(with_ids=True).groupBy("sequence_id").agg(
            F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        return grouped.mapInArrow(build, "sequence_id long, n_tokens long, ids array<int>, padding int")


def pack(docs: DataFrame, window: int = 1024, mixture: dict[str, float] | None = None,
         tokenizer: dict | None = None, end_id: int = 0) -> Packed:
    """Pack ``docs`` (doc_id, source, text) into sequences of at most ``window`` tokens.

    ``mixture``: target weights by source (sources not named form the pooled
    queue, with weight ``mixture["*"]`` or else their natural share); by default each
    source has its natural share."""
    scratch = Scratch(docs.sparkSession, "packing")
    toks = tokenize(docs, scratch, tokenizer, end_id)
    totals = scratch.save(toks.groupBy("pid", "src").agg(F.sum("n").alias("n")), "totals")
    everything = totals.agg(F.sum("n")).first()[0] or 0
    by_source = totals.groupBy("src").agg(F.sum("n").alias("n"))
    chosen = [s for s in mixture if s != "*"] if mixture else None
    named = by_source.where(F.col("src").isin(chosen)) if mixture else by_source.where(F.col("n") >= POOL_BELOW * everything)
    own = [(r["src"], r["n"]) for r in named.orderBy("src").collect()]  # at most 256 rows, or the named sources
    rest = everything - sum(n for _, n in own)
    supply = [rest, *(n for _, n in own)]  # the pooled queue first: it alone may have a tiny quantum
    weights = [float(n) for n in supply]
    if mixture:
        given = sum(mixture[s] for s, _ in own) or 1.0
        weights = [mixture.get("*", given * rest / max(1, everything - rest)), *(mixture[s] for s, _ in own)]
        if any(w * window < 2 * sum(weights) for w in weights[1:]):
            raise ValueError("a named source needs a target of two tokens a window at least")
    schedule = Schedule.plan(supply, weights, window)
    queue = F.lit(0)
    for i, (s, _) in enumerate(own):
        queue = F.when(F.col("src") == s, i + 1).otherwise(queue)
    # Partitions follow (source, doc_id), so a queue's order is (pid, src): a prefix over partitions, then one inside each.
    queued = totals.withColumn("queue", queue)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = queued.groupBy("queue", "pid").agg(F.sum("n").alias("n"))
    outer = outer.select("queue", "pid", before(Window.partitionBy("queue").orderBy("pid")).alias("parts_before"))
    inner = queued.select("pid", "src", "queue", before(Window.partitionBy("queue", "pid").orderBy("src")).alias("here_before"))
    offsets = inner.join(outer, ["queue", "pid"]).select("pid", "src", "queue", (F.col("parts_before") + F.col("here_before")).alias("before"))
    placed = toks.join(offsets, ["pid", "src"]).select("doc_id", "queue", (F.col("before") + F.col("local_start")).alias("at"), "n", "ids")
    pool = Interleave(rest, max(1, int(window * POOL_BELOW)))
    return Packed(placed, schedule, pool, docs.schema["doc_id"].dataType.simpleString())
