"""64-bit fingerprints and the bit arithmetic on them.

A fingerprint is a ``bigint`` holding the two's-complement bits of an
unsigned 64-bit value (Spark has no unsigned long).  Bit 0 is the lowest bit.

Providers (all produce the same column type, so the matching operators do not
care where a fingerprint came from):

* image pHash (``functions.phash``), the perceptual hash of the tool we mirror;
* text SimHash (Charikar 2002) - :func:`simhash_table`;
* vector median bits - :func:`median_bits`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import FINGERPRINT_BITS, LSH_BANDS
from ..session import bound_batches


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- scalar bit helpers -------------------------------------------------------

def hex_to_fp(hex_str: str | Column) -> Column:
    """Hex text of up to 16 digits -> signed bigint with the same 64 bits."""
    return F.conv(_c(hex_str), 16, -10).cast("bigint")


def bits_field(fp: str | Column, offset: int, width: int) -> Column:
    """Unsigned field of ``width`` bits starting at bit ``offset`` (as int)."""
    mask = (1 << width) - 1
    return F.shiftrightunsigned(_c(fp), offset).bitwiseAND(F.lit(mask).cast("bigint")).cast("int")


def chunk(fp: str | Column, k: int, bands: int = LSH_BANDS) -> Column:
    """Chunk ``k`` of ``bands`` equal chunks; chunk 0 holds the lowest bits."""
    width = FINGERPRINT_BITS // bands
    return bits_field(fp, k * width, width)


def chunk_columns(fp: str | Column, bands: int = LSH_BANDS, prefix: str = "c") -> list[Column]:
    return [chunk(fp, k, bands).alias(f"{prefix}{k}") for k in range(bands)]


def hamming(a: str | Column, b: str | Column) -> Column:
    """Hamming distance = popcount(a xor b); correct for negative (top-bit) values."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b))).cast("int")


def band_layout(bands: int, bits: int = FINGERPRINT_BITS) -> list[tuple[int, int]]:
    """Split ``bits`` into ``bands`` contiguous (offset, width) bands, widths differing by <= 1."""
    if not 1 <= bands <= bits:
        raise ValueError(f"bands must be in 1..{bits}, got {bands}")
    base, extra = divmod(bits, bands)
    out, off = [], 0
    for k in range(bands):
        w = base + (1 if k < extra else 0)
        out.append((off, w))
        off += w
    return out


def band_array(fp: str | Column, layout: Sequence[tuple[int, int]]) -> Column:
    """array<int> of band values, position = band index (feed to ``posexplode``)."""
    return F.array(*[bits_field(fp, off, w) for off, w in layout])


def neighbour_masks(width: int, radius: int) -> list[int]:
    """All ``width``-bit masks with popcount <= ``radius`` (XOR them onto a band value
    to enumerate its Hamming ball)."""
    from itertools import combinations

    out = []
    for r in range(radius + 1):
        for pos in combinations(range(width), r):
            m = 0
            for p in pos:
                m |= 1 << p
            out.append(m)
    return out


# --- SimHash over text --------------------------------------------------------

def raw_tokens(text: str | Column) -> Column:
    """Newline and tab become spaces, split on one space (empty tokens kept)."""
    return F.split(F.translate(_c(text), "\n\t", "  "), " ")


def tokens(text: str | Column) -> Column:
    """Newline and tab become spaces, split on one space, drop empty tokens."""
    return F.filter(raw_tokens(text), lambda w: w != "")


def token_hash(token: str | Column) -> Column:
    """First 16 hex digits of md5(token) as a 64-bit value."""
    return hex_to_fp(F.substring(F.md5(_c(token)), 1, 16))


def _or_bits(terms: Sequence[str]) -> Column:
    """Bit i from the i-th boolean SQL expression.  As one parsed text: 64 terms built column by column
    cost the driver seconds of calls a query."""
    return F.expr(" | ".join(f"shiftleft(cast({t} AS bigint), {i})" for i, t in enumerate(terms)))


def md5_starts(words):
    """The first 8 bytes of the md5 of every word of an Arrow array of large strings, as rows of a byte array."""
    import hashlib

    import numpy as np

    if not len(words):
        return np.zeros((0, 8), dtype=np.uint8)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    short = np.flatnonzero(size < 56)  # one block of 64 bytes with its length
    block, at = np.zeros((len(short), 64), dtype=np.uint8), np.arange(56)
    for n in np.unique(size[short]).tolist():
        rows = np.flatnonzero(size[short] == n)
        block[rows, :n] = data[offsets[short[rows], None] + at[:n]]
    block[np.arange(len(short)), size[short]] = 0x80
    block[:, 56:58] = (size[short] * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
    words32 = np.ascontiguousarray(block.view("<u4").T.astype(np.uint32))
    out = np.empty((len(words), 8), dtype=np.uint8)
    for i in range(0, len(short), 8192):
        out[short[i : i + 8192]] = _md5_block(words32[:, i : i + 8192])
    for i in np.flatnonzero(size >= 56).tolist():
        out[i] = np.frombuffer(hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes(), usedforsecurity=False).digest()[:8], np.uint8)
    return out


def _md5_block(m):
    """The first 8 bytes of the md5 of one-block messages, given as 16 rows of 32-bit words (RFC 1321)."""
    import math

    import numpy as np

    start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(m.shape[1], x, dtype=np.uint32) for x in start)
    turns = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += m[g]
        f += np.uint32(int(abs(math.sin(i + 1)) * 2**32))
        r = turns[turn][i % 4]
        a, b, c, d = d, b + ((f << np.uint32(r)) | (f >> np.uint32(32 - r))), b, c
    return np.stack([a + np.uint32(start[0]), b + np.uint32(start[1])], axis=1).astype("<u4").view(np.uint8)


def token_counts(texts) -> tuple:
    """(number of tokens, how many of them have each of the 64 bits set) of every text of an Arrow array.

    Arrow splits the texts and numbers their tokens; each distinct one is hashed once.  A token's 64 bits are
    64 bytes, added up eight at a time as the lanes of a ``uint64``: 255 tokens fill no lane."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    text = texts.cast(pa.large_string())
    for blank in "\n\t":
        text = pc.replace_substring(text, blank, " ")
    split = pc.split_pattern(text.fill_null(""), " ")
    coded, ends = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    bits = np.unpackbits(md5_starts(coded.dictionary)[:, ::-1], axis=1, bitorder="little")
    filled = pc.binary_length(coded.dictionary).to_numpy() > 0
    bits[~filled] = 0
    lanes, code = bits.view(np.uint64), coded.indices.to_numpy()

    def per_text(values, ends):
        """Sums of the ``values`` between each end and the next."""
        out = np.zeros((len(ends) - 1, *values.shape[1:]), dtype=np.int64)
        some = np.flatnonzero(np.diff(ends))
        if len(some):
            out[some] = np.add.reduceat(values, ends[some], axis=0, dtype=np.int64)
        return out

    n = per_text(filled[code], ends)
    parts = -(-np.diff(ends) // 255)  # of every text
    first = np.concatenate([[0], np.cumsum(parts)])
    starts = np.repeat(ends[:-1], parts) + (np.arange(first[-1]) - np.repeat(first[:-1], parts)) * 255
    sums = np.empty((len(starts), FINGERPRINT_BITS), dtype=np.uint8)
    for i in range(0, len(starts), 256):
        lo, hi = starts[i], starts[i + 256] if i + 256 < len(starts) else len(code)
        sums[i : i + 256] = np.add.reduceat(lanes.take(code[lo:hi], axis=0), starts[i : i + 256] - lo, axis=0).view(np.uint8)
    return n, per_text(sums, first)


#: Bytes of text that are split at once.
TEXT_BYTES = 4 << 20


def simhash_table(df: DataFrame, key: str, text: str, out: str = "fp") -> DataFrame:
    """(key, fp) with the 64-bit SimHash of ``text`` per ``key``; NULL when there are no tokens.

    Every text becomes its number of tokens and 64 sums in the task that read it (:func:`token_counts`); these
    65 numbers are grouped by key, so texts under one key count together.
    """
    bound_batches(df.sparkSession)
    counted = ["_n", *[f"_s{i}" for i in range(FINGERPRINT_BITS)]]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column(1)
            size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // TEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
            for lo, hi in zip(cuts, cuts[1:]):
                n, sums = token_counts(texts[lo:hi])
                cols = [pa.array(n), *[pa.array(np.ascontiguousarray(c)) for c in sums.T]]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *cols], names=["k", *counted])

    schema = StructType([StructField("k", df.schema[key].dataType), *[StructField(c, LongType()) for c in counted]])
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)
    g = rows.groupBy("k").agg(*[F.sum(c).alias(c) for c in counted])
    fp = _or_bits([f"(_s{i} * 2 > _n)" for i in range(FINGERPRINT_BITS)])  # more than half of the n tokens have it set
    return g.select(F.col("k").alias(key), F.when(F.col("_n") > 0, fp).cast("bigint").alias(out))


# --- vector median bits -------------------------------------------------------

def vector_median(vec: str | Column) -> Column:
    """Median in double: the mean of the two middle values of the sorted vector."""
    v = _c(vec)
    srt = F.array_sort(v)
    n = F.size(v)
    lo = F.get(srt, F.floor((n - 1) / 2).cast("int")).cast("double")
    hi = F.get(srt, F.floor(n / 2).cast("int")).cast("double")
    return (lo + hi) / 2.0


def median_bits(vec: str, med: str, dims: int = FINGERPRINT_BITS) -> Column:
    """bit i = (vec[i] > med), element i -> bit i (lowest first); strict comparison.

    A vector of more than ``dims`` elements is an error (a prefix would silently drop elements);
    a shorter one leaves the upper bits 0; null and empty vectors have no fingerprint."""
    v = F.col(vec)
    bits = _or_bits([f"coalesce(CAST(get(`{vec}`, {i}) AS double) > `{med}`, false)" for i in range(dims)])
    wrong = F.raise_error(F.concat(F.lit(f"median bits take at most {dims} elements, got "), F.size(v).cast("string")))
    return F.when(F.size(v) > dims, wrong.cast("bigint")).when(F.size(v) > 0, bits)


def with_median_bits(df: DataFrame, vec: str, out: str = "fp") -> DataFrame:
    """Adds ``out`` = vector median bits.  The median is projected first so the
    sort runs once per row (Catalyst does not inline a non-trivial alias that
    is referenced 64 times).  Row-local: no shuffle."""
    return df.withColumn("_med", vector_median(vec)).withColumn(out, median_bits(vec, "_med")).drop("_med")
