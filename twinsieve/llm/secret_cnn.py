"""Secret scan: base patterns, plus a character convolutional network over every other candidate.

Candidates are the runs of token characters of ``MIN_CANDIDATE`` or more that hold
both a letter and a digit.  Each is seen whole: cut into pieces of at most ``BODY``
characters that overlap by half, each with its surroundings (``LEFT`` characters
before, ``RIGHT`` after), and scored by its best piece.  The network is written in
numpy: character classes -> convolution -> ReLU -> maximum and mean over positions ->
logistic.  It is trained on labelled findings: pieces that overlap a base pattern's
span are positive, other pieces and a plain long word of every text (the one
with the smallest hash, wherever it stands) negative.  Scores are calibrated on held-out findings (Platt scaling) and the
threshold is the largest, to 1/``BINS`` of a logit, that keeps ``min_recall`` of the
held-out positives.

A quarter of all findings, by the hash of what the network sees, is held out; Spark
scores all of them into a histogram that calibration and threshold are taken from.
Weights are fitted on at most ``max_findings`` other findings of either label
(smallest hashes first); scanning covers every candidate of every whole text.

Defined results: null text is empty and has no span; repeated rows give equal rows;
without positives on both sides of the split or negatives to fit on there is nothing
to learn from or to set a threshold by, and no span is added; base spans always stay;
an added span that overlaps a base span is dropped; null ids and other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import Scratch, by_position

KINDS = ("assign", "access", "hex")
# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
WORDS = ("password", "passwd", "secret", "token", "api")
MIN_VALUE, MIN_ACCESS, MIN_CANDIDATE = 8, 16, 8
LEFT, BODY, RIGHT = 16, 40, 8
WIDTH = LEFT + BODY + RIGHT
BINS, LIMIT = 64, 64  # of the histogram of logits: bins to a unit; beyond +-LIMIT one bin takes all


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):  # a cheap necessary condition
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # Runs are maximal either way, so asking for 32 or more equals dropping the shorter ones.
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not s.isalpha() and any(map(str.isdigit, s)) and any(map(str.isalpha, s)):
            out.append((m.start(), m.end()))
    return out


class Cover:
    """What the spans (by start) cover, for overlap tests by binary search."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends = [], []
        for s, e, _ in spans:
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def overlaps(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.ends) and self.starts[i] < b


# Character classes the network sees (index 0: padding, last: any other character).
CLASSES = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_-", "=", ":", "\"'", " ", "\n\t", ".,;!?", "()[]{}<>", "@"]
TABLE = np.full(128, len(CLASSES) + 1, dtype=np.int8)
for _i, _c in enumerate(CLASSES):
    TABLE[[ord(x) for x in _c]] = _i + 1
N_CLASSES = len(CLASSES) + 2


def pieces(a: int, b: int):
    """(start, end) of the pieces of a candidate: at most ``BODY`` long, overlapping by half, together all of it."""
    at = a
    while at + BODY < b:
        yield at, at + BODY
        at = min(at + BODY // 2, b - BODY)
    yield at, b


def window(text: str, a: int, b: int) -> np.ndarray:
    """Class codes of a piece and its surroundings, the piece at a fixed place."""
    left, body, right = text[max(0, a - LEFT) : a], text[a:b], text[b : b + RIGHT]
    out = np.zeros(WIDTH, dtype=np.int8)
    for at, part in ((LEFT - len(left), left), (LEFT, body), (LEFT + BODY, right)):
        code = np.frombuffer(part.encode("utf-32-le"), dtype="<u4")
        out[at : at + len(part)] = np.where(code < 128, TABLE[np.minimum(code, 127)], N_CLASSES - 1)
    return out


@dataclass
class CharCnn:
    """One-hot classes -> convolution -> ReLU -> max and mean over positions -> logistic, with Platt scaling."""

    kernel: np.ndarray  # (taps * N_CLASSES, filters)
    bias: np.ndarray
    out: np.ndarray  # (2 * filters,)
    out_bias: float
    taps: int = 5
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0  # above every probability: nothing is added

    def _columns(self, x: np.ndarray) -> np.ndarray:
        hot = np.eye(N_CLASSES, dtype=np.float32)[x]
        hot[..., 0] = 0
        views = [hot[:, t : x.shape[1] - self.taps + 1 + t] for t in range(self.taps)]
        return np.concatenate(views, axis=2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(x), 512):
            h = np.maximum(self._columns(x[at : at + 512]) @ self.kernel + self.bias, 0)
            parts.append(np.concatenate([h.max(1), h.mean(1)], axis=1) @ self.out + self.out_bias)
        return np.concatenate(parts) if parts else np.empty(0)

    def _probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -50, 50)))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._probability(self.logits(x))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 5, min_recall: float = 0.99) -> CharCnn:
        """Weights on three quarters of the findings, calibration and threshold on the others."""
        order = np.random.default_rng(seed).permutation(len(y))
        held, used = order[: len(y) // 4], order[len(y) // 4 :]
        net = cls.learn(x[used], y[used], seed=seed)
        at, n = np.unique(np.stack([y[held], net.bins(x[held])]), axis=1, return_counts=True)
        net.settle(at[0], at[1], n, min_recall)
        return net

    @classmethod
    def learn(cls, x: np.ndarray, y: np.ndarray, filters: int = 12, epochs: int = 5, batch: int = 64,
              rate: float = 0.01, seed: int = 5) -> CharCnn:
        rng = np.random.default_rng(seed)
        net = cls(rng.normal(0, 0.1, (5 * N_CLASSES, filters)).astype(np.float32), np.zeros(filters, np.float32),
                  rng.normal(0, 0.1, 2 * filters).astype(np.float32), 0.0)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.kernel, net.bias, net.out, np.zeros(1))]
        step = 0
        for _ in range(epochs):
            for _ in range(0, len(y), batch):
                i = rng.permutation(len(y))[:batch]
                cols = net._columns(x[i])
                pre = cols @ net.kernel + net.bias
                h = np.maximum(pre, 0)
                top = h.argmax(1)
                pooled = np.concatenate([h.max(1), h.mean(1)], axis=1)
                p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -50, 50)))
                d = ((p - y[i]) / len(i)).astype(np.float32)
                d_pool = d[:, None] * net.out
                d_h = np.repeat(d_pool[:, None, filters:] / h.shape[1], h.shape[1], axis=1)
                np.put_along_axis(d_h, top[:, None, :], np.take_along_axis(d_h, top[:, None, :], 1) + d_pool[:, None, :filters], 1)
                d_h *= pre > 0
                grads = [np.einsum("bpk,bpf->kf", cols, d_h, optimize=True), d_h.sum((0, 1)), pooled.T @ d, np.array([d.sum()])]
                step += 1
                moved = []
                for g, s in zip(grads, state, strict=True):
                    s[0] = 0.9 * s[0] + 0.1 * g
                    s[1] = 0.999 * s[1] + 0.001 * g * g
                    moved.append(rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8))
                net.kernel = (net.kernel - moved[0]).astype(np.float32)
                net.bias = (net.bias - moved[1]).astype(np.float32)
                net.out = (net.out - moved[2]).astype(np.float32)
                net.out_bias -= float(moved[3][0])
        return net

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.floor(np.clip(self.logits(x), -LIMIT, LIMIT) * BINS).astype(np.int64)

    def settle(self, y: np.ndarray, bins: np.ndarray, n: np.ndarray, min_recall: float) -> None:
        """Calibration and threshold from a histogram of logits: ``n`` findings of label ``y`` in each of ``bins``."""
        if not n[y == 1].sum():
            return
        self._calibrate((bins + 0.5) / BINS, y, n.astype(float))
        low = np.where(bins <= -LIMIT * BINS, -np.inf, bins / BINS)
        high = np.where(bins >= LIMIT * BINS, np.inf, (bins + 1) / BINS)
        # What the findings of a bin reach at least.
        p = self._probability(low if self.scale >= 0 else high)
        down = np.argsort(-p[y == 1], kind="stable")
        kept = np.cumsum(n[y == 1][down])
        self.threshold = float(p[y == 1][down][np.searchsorted(kept, min_recall * kept[-1])])

    def _calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 500) -> None:
        """Platt scaling with smoothed targets, by gradient descent on standardised logits; ``n``: weights."""
        n1, n0 = n[y == 1].sum(), n[y == 0].sum()
        if not n1 or not n0:
            return
        target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        w = n / n.sum()
        m = (w * z).sum()
        s = np.sqrt((w * (z - m) ** 2).sum()) + 1e-6
        u, a, b = (z - m) / s, 1.0, 0.0
        for _ in range(steps):
            e = 1 / (1 + np.exp(-np.clip(a * u + b, -50, 50))) - target
            a, b = a - (w * e * u).sum(), b - (w * e).sum()
        self.scale, self.shift = a / s, b - a * m / s


def findings(docs: DataFrame) -> DataFrame:
    """Every piece of a candidate with its label: (doc_id, at, y, x): y = 1 where it overlaps a base pattern's span."""

    def run(batches):
        import pyarrow as pa

        def found(texts):
            for i, t in enumerate(texts):
                text = t.as_py() or ""
                cover = Cover(base_spans(text))
                for a, b in candidates(text):
                    for s, e in pieces(a, b):
                        yield i, s, int(cover.overlaps(s, e)), window(text, s, e).tobytes()

        for batch in batches:
            rows = found(batch.column("text"))
            while part := list(islice(rows, 4096)):
                doc, at, ys, xs = zip(*part, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(doc, pa.int64())), "at": pa.array(at, pa.int64()),
                                                  "y": pa.array(ys, pa.int32()), "x": pa.array(xs, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, at long, y int, x binary")


def plain_words(docs: DataFrame) -> DataFrame:
    """A long plain word of every text as a further negative, one piece of it: (doc_id, at, y, x).

    Word and piece are those of the smallest hash, so any place of a whole text may be the one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            doc, at, xs = [], [], []
            for i, t in enumerate(batch.column("text")):
                text = t.as_py() or ""
                cover = Cover(base_spans(text))
                words = (m for m in re.finditer(r"\S{8,}", text) if not cover.overlaps(m.start(), m.end()))
                m = min(words, key=lambda m: (zlib.crc32(m[0].encode()), m.start()), default=None)
                if m:
                    a, b = min(pieces(m.start(), m.end()), key=lambda p: (zlib.crc32(text[p[0] : p[1]].encode()), p))
                    doc.append(i)
                    at.append(a)
                    xs.append(window(text, a, b).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(doc, pa.int64())), "at": pa.array(at, pa.int64()),
                                              "y": pa.array([0] * len(at), pa.int32()), "x": pa.array(xs, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, at long, y int, x binary")


def train(docs: DataFrame, max_findings: int = 1536, min_recall: float = 0.99) -> CharCnn:
    """Weights from at most ``max_findings`` findings of either label, calibration and threshold from all held-out ones."""
    scratch = Scratch(docs.sparkSession, "secrets")
    narrow = docs.select("doc_id", "text")
    # One column for the split: equal windows are on the same side of it.
    got = scratch.save(findings(narrow).unionByName(plain_words(narrow)).withColumn("held", F.pmod(F.xxhash64(F.lit(1), "x"), F.lit(4)) == 0), "findings")
    take = lambda y: got.where((F.col("y") == y) & ~F.col("held")).orderBy(F.xxhash64("x", "doc_id", "at"), "doc_id", "at").limit(max_findings).collect()
    rows = {y: take(y) for y in (0, 1)}
    none = CharCnn(np.zeros((5 * N_CLASSES, 1), np.float32), np.zeros(1, np.float32), np.zeros(2, np.float32), 0.0)
    if not rows[0] or not rows[1]:
        return none
    both = [*rows[0], *rows[1]]
    x = np.array([np.frombuffer(r["x"], dtype=np.int8) for r in both])
    net = CharCnn.learn(x, np.array([r["y"] for r in both]))

    def binned(batches):
        import pyarrow as pa

        for batch in batches:
            seen = [np.frombuffer(v, dtype=np.int8) for v in batch.column("x").to_pylist()]
            if seen:
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(net.bins(np.array(seen)), pa.int64())], names=["y", "bin"])

    counts = got.where("held").select("y", "x").mapInArrow(binned, "y int, bin long").groupBy("y", "bin").count().collect()
    net.settle(np.array([r["y"] for r in counts]), np.array([r["bin"] for r in counts]), np.array([r["count"] for r in counts]), min_recall)
    return net


def kind_of(value: str) -> str:
    if ACCESS.fullmatch(value):
        return "access"
    return "hex" if HEX.fullmatch(value) else "assign"


def all_spans(texts: list[str], model: CharCnn) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; the network sees the candidates of the whole batch in chunks of pieces.

    A candidate is added where any of its pieces reaches the threshold."""
    base = [base_spans(t) for t in texts]
    cover = [Cover(s) for s in base]
    asked = ((i, a, b, s, e) for i, t in enumerate(texts) for a, b in candidates(t) if not cover[i].overlaps(a, b) for s, e in pieces(a, b))
    spans = [list(s) for s in base]
    last = None
    while part := list(islice(asked, 4096)):
        p = model.probabilities(np.array([window(texts[i], s, e) for i, _, _, s, e in part]))
        for (i, a, b, _, _), q in zip(part, p.tolist(), strict=True):
            if q >= model.threshold and (i, a) != last:
                spans[i].append((a, b, kind_of(texts[i][a:b])))
                last = i, a
    return [(b, sorted(s, key=lambda v: (v[0], KINDS.index(v[2])))) for b, s in zip(base, spans, strict=True)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, model: CharCnn) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): counts are of the base spans."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = all_spans([t.as_py() or "" for t in batch.column("text")], model)
            count = {k: pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS}
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), **{f"n_{k}": v for k, v in count.items()},
                "base": pa.array([joined(b) for b, _ in found], pa.string()), "spans": pa.array([joined(s) for _, s in found], pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def redact(docs: DataFrame, model: CharCnn, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` (overlapping spans once); all other columns as they are."""
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = []
            for t, (_, spans) in zip(texts, all_spans([t or "" for t in texts], model), strict=True):
                parts, pos = [], 0
                for a, b, _ in spans:
                    if a >= pos:
                        parts += [t[pos:a], mark]
                    pos = max(pos, b)
                out.append("".join([*parts, t[pos:]]) if parts else t)
            columns = batch.columns
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return by_position(docs).mapInArrow(run, schema)
