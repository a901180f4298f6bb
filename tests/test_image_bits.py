"""pHash bits against whole-number arithmetic written out, and image headers of every format."""

import math
import os
import random
import struct

import numpy as np
import pytest

from twinsieve.functions.phash import fixed_matrix, phash_pixels
from twinsieve.sources.images import header_size, phash_provider, png_bytes


def plain_resize(rows, out):
    """Rows of 8-bit values resized to ``out`` columns, one integer at a time."""
    size = len(rows[0])
    scale = size / out
    wide = max(scale, 1.0)

    def lanczos(x):
        if x == 0:
            return 1.0
        return math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3) if -3 <= x < 3 else 0.0

    done = [[] for _ in rows]
    for i in range(out):
        center = (i + 0.5) * scale
        lo, hi = max(0, int(center - 3 * wide + 0.5)), min(size, int(center + 3 * wide + 0.5))
        k = [lanczos((x - center + 0.5) / wide) for x in range(lo, hi)]
        k = [v / sum(k) for v in k]
        k = [int(v * (1 << 22) + (0.5 if v >= 0 else -0.5)) for v in k]
        for r, d in zip(rows, done):
            d.append(max(0, min(255, ((1 << 21) + sum(int(p) * w for p, w in zip(r[lo:hi], k))) >> 22)))
    return done


def plain_phash(pixels):
    grey = [[(19595 * int(p[2]) + 38470 * int(p[1]) + 7471 * int(p[0]) + 32768) >> 16 if np.ndim(p) else int(p) for p in row] for row in pixels]
    small = plain_resize(grey, 32)
    small = [list(r) for r in zip(*plain_resize([list(c) for c in zip(*small)], 32))]
    cos = [[math.cos(math.pi * u * (2 * i + 1) / 64) for i in range(32)] for u in range(8)]
    low = [sum(cos[u][y] * sum(cos[v][x] * small[y][x] for x in range(32)) for y in range(32)) for u in range(8) for v in range(8)]
    mid = sorted(low)
    bits = "".join("1" if d > (mid[31] + mid[32]) / 2 else "0" for d in low)
    v = int(bits, 2)
    return v - (1 << 64) if v >= 1 << 63 else v


@pytest.mark.parametrize("h,w", [(32, 32), (64, 64), (37, 53), (5, 7), (300, 41), (33, 31), (3, 90), (128, 256)])
def test_bits_equal_whole_number_arithmetic(h, w):
    rnd = np.random.default_rng(h * 1000 + w)
    for pixels in (rnd.integers(0, 256, (h, w), dtype=np.uint8), rnd.integers(0, 256, (h, w, 3), dtype=np.uint8),
                   np.where(rnd.random((h, w)) < 0.5, 0, 255).astype(np.uint8)):  # sharp edges overshoot and are clipped
        assert phash_pixels(pixels) == plain_phash(pixels.tolist() if pixels.ndim == 2 else pixels)


def pattern(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return ((x * x * 3 + y * y * 5 + x * y * 7 + 11 * x) % 251).astype(np.uint8)


MASK = (1 << 64) - 1
# fixed values: fingerprints of ``pattern(height, width)``, from the arithmetic written out above
PINNED = {(48, 64): 0xe3e569aa4760c2ec, (100, 30): 0x8cd3ec515ea558a5, (64, 64): 0xe2f56af52a8568b0, (31, 200): 0xd6ad5231a955d52a}


def test_weights_are_whole_and_add_up():
    for n in (5, 31, 32, 33, 64, 1000):
        k = fixed_matrix(n, 32)
        assert (k == np.trunc(k)).all() and abs(k.sum(1) - (1 << 22)).max() <= k.shape[1]
    assert (fixed_matrix(32, 32) == np.eye(32) * (1 << 22)).all()


def test_pinned_images_through_spark(spark, tmpdir_path):
    paths = {}
    for (h, w), fp in PINNED.items():
        path = f"{tmpdir_path}/{h}x{w}.png"
        with open(path, "wb") as f:
            f.write(png_bytes(pattern(h, w)))
        assert plain_phash(pattern(h, w).tolist()) & MASK == fp
        paths[path] = fp
    got = {r.path: r.fp & MASK for r in phash_provider(spark)(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == paths


# --- headers ---------------------------------------------------------------------------------------------------


def tiff(order, w, h, big=False, pages=1, short=False):
    """A header and ``pages`` directories; the pixels are not there at all."""
    kind, at = (43, 16) if big else (42, 8)
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", kind)
    out += struct.pack(order + "HHQ", 8, 0, at) if big else struct.pack(order + "I", at)
    for p in range(pages):
        scale = 1 if p == pages - 1 else 2  # the largest page comes last
        entries = [(256, w // scale), (257, h // scale), (258, 8)]
        body = struct.pack(order + ("Q" if big else "H"), len(entries))
        for tag, v in entries:
            if big:
                body += struct.pack(order + "HHQ", tag, 16, 1) + struct.pack(order + "Q", v)
            else:
                body += struct.pack(order + "HHI", tag, 3 if short else 4, 1) + (struct.pack(order + "HH", v, 0) if short else struct.pack(order + "I", v))
        size = len(body) + (8 if big else 4)
        at += size
        out += body + struct.pack(order + ("Q" if big else "I"), at if p < pages - 1 else 0)
    return out


def webp(kind, w, h):
    if kind == b"VP8X":
        body = b"\x00" * 4 + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
    elif kind == b"VP8L":
        body = b"\x2f" + ((w - 1) | (h - 1) << 14).to_bytes(4, "little") + b"\x00" * 5
    else:
        body = b"\x10\x00\x00\x9d\x01\x2a" + struct.pack("<HH", w, h)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def heif(*sizes):
    ispe = b"".join(box(b"ispe", b"\x00" * 4 + struct.pack(">II", *s)) for s in sizes)
    meta = box(b"meta", b"\x00" * 4 + box(b"hdlr", b"\x00" * 20) + box(b"iprp", box(b"ipco", box(b"colr", b"abcd") + ispe) + box(b"ipma", b"")))
    return box(b"ftyp", b"heic" + b"\x00" * 4 + b"mif1") + box(b"free", b"x" * 100) + meta + box(b"mdat", b"")


HEADERS = {
    "little.tif": (tiff("<", 70000, 50000), (70000, 50000)), "big.tif": (tiff(">", 70000, 50000), (70000, 50000)), "short.tiff": (tiff(">", 640, 480, short=True), (640, 480)),
    "huge.tif": (tiff("<", 1 << 33, 9, big=True), (1 << 33, 9)), "pages.tif": (tiff("<", 6000, 4000, pages=5), (6000, 4000)),
    "x.webp": (webp(b"VP8X", 16000, 12000), (16000, 12000)), "l.webp": (webp(b"VP8L", 16000, 12000), (16000, 12000)), "y.webp": (webp(b"VP8 ", 16000, 12000), (16000, 12000)),
    "a.heic": (heif((512, 512), (24000, 18000), (160, 120)), (24000, 18000)),
}


@pytest.mark.parametrize("name", sorted(HEADERS))
def test_sizes_from_headers(tmpdir_path, name):
    data, size = HEADERS[name]
    with open(f"{tmpdir_path}/{name}", "wb") as f:
        f.write(data)
    assert header_size(f"{tmpdir_path}/{name}") == size


def test_broken_headers_are_no_sizes(tmpdir_path):
    rnd = random.Random(1)
    for name, (data, _) in HEADERS.items():
        for _ in range(40):
            cut = bytearray(data[: rnd.randint(0, len(data))])
            for _ in range(3):
                if cut:
                    cut[rnd.randrange(len(cut))] = rnd.randrange(256)
            path = f"{tmpdir_path}/{name}"
            with open(path, "wb") as f:
                f.write(cut)
            size = header_size(path)
            assert size is None or len(size) == 2
    looped = bytearray(tiff("<", 10, 10))
    looped[-4:] = struct.pack("<I", 8)  # the last directory names the first
    with open(f"{tmpdir_path}/loop.tif", "wb") as f:
        f.write(looped)
    assert header_size(f"{tmpdir_path}/loop.tif") == (10, 10)


def test_oversized_headers_are_never_linked_for_decoding(spark, tmpdir_path):
    from twinsieve.sources.images import _link_images

    for name, (data, _) in HEADERS.items():
        with open(f"{tmpdir_path}/{name}", "wb") as f:
            f.write(data)
    df = spark.createDataFrame([(f"{tmpdir_path}/{n}",) for n in HEADERS], "path string")
    got = {os.path.basename(r.path): r.name for r in df.mapInArrow(_link_images(f"{tmpdir_path}/links", 10_000_000), "path string, name string").collect()}
    assert {n for n, linked in got.items() if linked} == {"short.tiff"}  # the others pass twice the limit, pages.tif included
