"""64-bit perceptual hash (DCT pHash) of decoded images, as a pandas UDF.

Recipe (the public ``imagehash.phash`` defaults): grey = ITU-R 601 luma in
integer arithmetic; resize to 32x32 with a Lanczos (a = 3) kernel, horizontal
then vertical pass; 2-D DCT-II as ``C @ X @ C.T``; keep the top-left 8x8; bit =
coefficient > median of the 64; row-major, first bit most significant.

The resize is the fixed-point one of the imaging library that this recipe is defined on: kernel
weights are normalised in double and rounded (half away from zero) to 22 fractional
bits, each pass sums integers, adds one half, shifts and clips to 8 bits, and the second pass
starts from the first one's bytes.  The sums stay far below 2^53, so they are done as double matrix
products of whole numbers: exact in any order.  Stored fingerprints therefore compare with
those of that library bit by bit, up to its own decoder's pixels.

Input is Spark's ``image`` struct (BGR(A) bytes, row-major).  One Python call
per Arrow batch; the per-image work is NumPy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_SIZE = 8
IMG_SIZE = 32

_n = np.arange(IMG_SIZE)
DCT_MATRIX = np.cos(np.pi * np.outer(_n, 2 * _n + 1) / (2 * IMG_SIZE))
BIT_WEIGHTS = [1 << (63 - i) for i in range(64)]


def _lanczos(x: np.ndarray, a: float = 3.0) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < a, np.sinc(x) * np.sinc(x / a), 0.0)


def resample_matrix(in_size: int, out_size: int) -> np.ndarray:
    """(out_size, in_size) normalised Lanczos weights; support widens when shrinking."""
    scale = in_size / out_size
    filt = max(scale, 1.0)
    support = 3.0 * filt
    w = np.zeros((out_size, in_size))
    for i in range(out_size):
        center = (i + 0.5) * scale
        lo = max(int(center - support + 0.5), 0)
        hi = min(int(center + support + 0.5), in_size)
        xs = np.arange(lo, hi)
        k = _lanczos((xs - center + 0.5) / filt)
        s = k.sum()
        w[i, lo:hi] = k / s if s else k
    return w


FRACTION_BITS = 22  # of the fixed-point kernel weights


def fixed_matrix(in_size: int, out_size: int) -> np.ndarray:
    """:func:`resample_matrix` in units of 2^-22, whole numbers held as doubles."""
    w = resample_matrix(in_size, out_size) * (1 << FRACTION_BITS)
    return np.trunc(w + np.copysign(0.5, w))


def to_bytes(sums: np.ndarray) -> np.ndarray:
    """Fixed-point sums as clipped 8-bit values."""
    return np.clip(np.floor((sums + (1 << (FRACTION_BITS - 1))) / (1 << FRACTION_BITS)), 0, 255)


STRIP = 256  # image rows widened at a time


def luma(px: np.ndarray) -> np.ndarray:
    """Grey of (rows, width[, channels]) 8-bit pixels."""
    if px.ndim == 2:
        return px.astype(np.int64)
    b, g, r = (px[..., i].astype(np.int64) for i in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16


def phash_pixels(px: np.ndarray) -> int:
    """Signed 64-bit pHash of 8-bit pixels; widened to 64 bits in strips of rows only."""
    h, w = px.shape[:2]
    across = fixed_matrix(w, IMG_SIZE).T
    tmp = np.empty((h, IMG_SIZE))
    for y in range(0, h, STRIP):
        tmp[y : y + STRIP] = to_bytes(luma(px[y : y + STRIP]).astype(np.float64) @ across)
    small = to_bytes(fixed_matrix(h, IMG_SIZE) @ tmp)
    dct = DCT_MATRIX @ small @ DCT_MATRIX.T
    low = dct[:HASH_SIZE, :HASH_SIZE]
    bits = (low > np.median(low)).flatten()
    v = sum(wt for wt, b in zip(BIT_WEIGHTS, bits) if b)
    return v - (1 << 64) if v >= 1 << 63 else v


@F.pandas_udf(T.LongType())
def phash_image(img: pd.DataFrame) -> pd.Series:
    """pHash of an ``image`` struct; NULL for undecodable images (height < 1 or no data)."""
    out = []
    for h, w, c, d in zip(img["height"], img["width"], img["nChannels"], img["data"]):
        if d is None or h is None or h < 1 or w < 1 or len(d) < h * w * c:
            out.append(None)
            continue
        try:
            px = np.frombuffer(d, dtype=np.uint8, count=h * w * c)
            out.append(phash_pixels(px.reshape(h, w) if c == 1 else px.reshape(h, w, c)))
        except Exception:  # noqa: BLE001 - an odd image falls through, it never fails the task
            out.append(None)
    return pd.Series(out, dtype="Int64")


def image_phash(image: str | Column = "image") -> Column:
    return phash_image(F.col(image) if isinstance(image, str) else image)
