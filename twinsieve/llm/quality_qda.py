"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of the whole text (length, word shape, repetition, symbol and letter
shares, a learned word-evidence statistic) are transformed (logs, clipped
z-scores); each class gets a mean and a covariance shrunk towards its diagonal
and a scaled identity; the score is the logistic of the difference of the class
log densities, computed through cached Cholesky factors.

The word evidence is the log odds of hashed words between the classes, shrunk
towards zero where counts are low; it is counted on one part of the labelled
sample and the covariances on the other, so neither sees its own rows.

Fitting uses a sample of at most ``max_rows`` labelled rows (smallest hashes of
``doc_id``): its ids are a broadcast of proven size, its documents one written
table.  Everything else covers all documents.  Labels, language, source and id
are never inputs of a score.

Defined results: null text counts as empty and is scored; rows with null
``doc_id`` are scored (never used for fitting); a document labelled more than once
takes its lowest label; null labels are ignored; without both classes in the
sample every score is the share of label 1 (0.5 without labels); repeated rows get
equal scores; other columns do not matter.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import Scratch, by_position

BUCKETS = 1 << 16
#: Pseudo-documents that pull a word's log odds to zero.
WORD_PRIOR = 20.0
CLIP = 4.0
EPS = 1e-3
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
COMMON_MARKS = np.zeros(256, dtype=bool)
COMMON_MARKS[[ord(c) for c in ",.;:'\"()-?"]] = True
SPACE = [9, 10, 11, 12, 13, 32]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def word_buckets(words: set[bytes]) -> np.ndarray:
    return np.unique(np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in words), dtype=np.int64, count=len(words)))


def statistics(text: bytes, weights: np.ndarray | None) -> list[float]:
    words = text.split()
    n, nw = max(1, len(text)), max(1, len(words))
    h = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    letters = max(1, h[65:91].sum() + h[97:123].sum() + h[128:].sum())
    marks = h.sum() - h[ALNUM].sum() - h[SPACE].sum()
    lower = [w.lower().strip(b".,;:!?\"'()") for w in words]
    distinct = set(lower)
    same = sum(map(bytes.__eq__, words, words[1:]))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    evidence = np.zeros(1)
    if weights is not None and distinct:
        evidence = weights[word_buckets(distinct)]
    top = np.sort(evidence)[-3:]
    return [
        np.log1p(len(words)),
        np.log(sizes.mean() + 1),
        np.log(sizes.std() + 1),
        np.log(h[65:91].sum() / letters + EPS),
        np.log((marks - h[COMMON_MARKS].sum()) / n + EPS),
        np.log(h[COMMON_MARKS].sum() / n + EPS),
        np.log(h[48:58].sum() / n + EPS),
        np.log(same / nw + EPS),
        np.log(len(distinct) / nw ** 0.9 + EPS),
        float(top[-1]),
        float(top.sum()),
        float(evidence.mean()),
    ]


@dataclass
class Discriminant:
    """Class means and Cholesky factors; ``scores`` never refactors."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    weights: np.ndarray | None = None
    constant: float | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, shrink: float = 0.1, ridge: float = 0.3) -> Discriminant:
        if len(set(y.tolist())) < 2:
            share = float(y.mean()) if len(y) else 0.5
            return cls(np.zeros(1), np.ones(1), [], [], [], constant=share)
        centre, scale = x.mean(0), x.std(0) + 1e-6
        z = np.clip((x - centre) / scale, -CLIP, CLIP)
        means, factors, offsets = [], [], []
        for k in (0, 1):
            own = z[y == k]
            mean = own.mean(0)
            cov = (own - mean).T @ (own - mean) / max(1, len(own) - 1)
            cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.eye(len(mean))
            low = np.linalg.cholesky(cov)
            means.append(mean)
            factors.append(np.linalg.inv(low))
            offsets.append(float(np.log(len(own) / len(z)) - np.log(np.diag(low)).sum()))
        return cls(centre, scale, means, factors, offsets)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.centre) / self.scale, -CLIP, CLIP)
        log_density = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -500, 500)))


def _features(df: DataFrame, weights: np.ndarray | None, model: Discriminant | None) -> DataFrame:
    """(``keep`` columns, x array) or, with a model, (``keep`` columns, score)."""
    at = df.columns.index("text")
    keep = [(i, c) for i, c in enumerate(df.columns) if i != at]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([statistics(t.as_py() or b"", weights) for t in batch.column(at)], dtype=np.float64)
            if not len(x):
                continue
            last = pa.array(model.scores(x)) if model else pa.array(x.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, _ in keep), last], names=[*(c for _, c in keep), "out"])

    types = ", ".join(f"`{c}` {df.schema[i].dataType.simpleString()}" for i, c in keep)
    return by_position(df.withColumn("text", F.col("text").cast("binary"))).mapInArrow(run, f"{types}, out {'double' if model else 'array<double>'}")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 32_768) -> Discriminant:
    """Fit on the labelled rows outside the held-out fifth, at most ``max_rows`` of them."""
    scratch = Scratch(docs.sparkSession, "quality")
    known = (
        labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    )
    sample = scratch.save(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "sample")
    chosen = scratch.save(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "texts")  # max_rows ids: a fixed bound
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 <= 2

    def buckets(batches):
        import pyarrow as pa

        for batch in batches:
            counts = np.zeros((2, BUCKETS), dtype=np.int64)
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                counts[int(y > 0), word_buckets({w.lower().strip(b".,;:!?\"'()") for w in (t.as_py() or b"").split()})] += 1
            k = np.flatnonzero(counts.sum(0))
            yield pa.RecordBatch.from_pydict({"k": pa.array(k), "n0": pa.array(counts[0, k]), "n1": pa.array(counts[1, k])})

    spread = chosen.where(part).select(F.col("text").cast("binary").alias("text"), "y")
    counted = spread.mapInArrow(buckets, "k long, n0 long, n1 long").groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    sizes = {r["y"]: r["n"] for r in chosen.where(part).groupBy("y").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(BUCKETS)
    n0, n1 = sizes.get(0, 0), sum(n for y, n in sizes.items() if y > 0)
    if n0 and n1:
        p0 = n0 / (n0 + n1)
        weights[counted["k"].to_numpy(dtype=np.int64)] = (
            np.log((counted["n0"].to_numpy(float) + WORD_PRIOR * p0) / (counted["n1"].to_numpy(float) + WORD_PRIOR * (1 - p0))) - np.log(n0 / n1))
    rows = _features(chosen.where(~part).select("y", "doc_id", "text"), weights, None).orderBy("doc_id").toPandas()  # max_rows x statistics
    x = np.array(rows["out"].tolist(), dtype=np.float64) if len(rows) else np.empty((0, 1))
    model = Discriminant.fit(x, (rows["y"].to_numpy() > 0).astype(int))
    model.weights = weights
    return model


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """``docs`` (any columns beside ``text``) with ``text`` replaced by ``out``, the score."""
    return _features(docs, model.weights, model)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """``docs`` without the documents scored below ``threshold``; all columns kept."""
    model = train(docs, labels, **params)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at)
            x = np.array([statistics((t.as_py() or "").encode(), model.weights) for t in texts], dtype=np.float64)
            if len(x):
                kept = batch.filter(pa.array(model.scores(x) >= threshold))
                yield pa.RecordBatch.from_arrays(kept.columns, names=schema.names)

    return by_position(docs).mapInArrow(run, schema)
