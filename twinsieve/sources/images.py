"""Decoded images and their perceptual hashes.

Spark's ``image`` source decodes on the executors (Java ImageIO: bmp, gif,
jpeg, png, tiff, wbmp; no webp/heic - those get no fingerprint and fall through
to ``copied``, as images the mirrored tool cannot open do).  Undecodable files
are kept as rows with no data (``dropInvalid`` off) so they get a NULL
fingerprint instead of vanishing.

A provider decodes exactly the paths it is given.  Tasks read each file's header,
drop images above the pixel limit before anything is inflated, and link the others
under plain names into a folder of the shared checkpoint folder (copy them there where
tree or folder is not mounted), which the image source then reads: hidden and ``_``-prefixed files (which Spark's listing skips)
are decoded like any other, files that need no fingerprint are not decoded at all.
Sizes are read from PNG, GIF, BMP, JPEG, TIFF (also 64-bit, all pages), WebP and HEIF headers; the
pixel limit is checked again after decoding, for files whose header is not understood.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_MAX_IMAGE_PIXELS, IMAGE_EXTENSIONS
from ..functions.paths import normalise_uri
from ..functions.phash import image_phash
from ..operators.filters import is_image, normalise_extensions, within_pixel_limit
from ..session import qualified, scratch_folder
from .filesystems import copy_file, is_remote, mounted, open_seekable

_GLOB_SPECIAL = set("{}[]*?,\\")
# Header reading stops here: a file of more pages or entries has no known size before decoding.
MAX_PAGES, MAX_ENTRIES = 4096, 65536


def extension_glob(extensions) -> str:
    """Case-insensitive Hadoop glob for names ending in one of ``extensions``
    (``('.jpg', '.png')`` -> ``*.{[jJ][pP][gG],[pP][nN][gG]}``)."""

    def one(ext: str) -> str:
        return "".join(
            f"[{c.lower()}{c.upper()}]" if c.isalpha() else ("\\" + c if c in _GLOB_SPECIAL else c) for c in ext.lstrip(".")
        )

    return "*.{" + ",".join(one(e) for e in extensions) + "}"


def image_extensions(extensions=None) -> tuple[str, ...]:
    """Image extensions to decode: the image set, narrowed by a user extension filter."""
    user = normalise_extensions(extensions)
    return tuple(e for e in IMAGE_EXTENSIONS if not user or e in user)


def read_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    return (
        spark.read.format("image")
        .option("dropInvalid", False)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", extension_glob(extensions))
        .load(root)
        .select(normalise_uri("image.origin").alias("path"), "image")
    )


def header_size(path: str) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF, BMP, JPEG, TIFF, WebP or HEIF; None when it is none of them, or broken."""
    with open_seekable(path) as f:
        try:
            return _size_in(f)
        except (OSError, struct.error, IndexError, ValueError, OverflowError):
            return None


def _size_in(f) -> tuple[int, int] | None:
    head = f.read(32)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
        return struct.unpack(">II", head[16:24])
    if head[:4] == b"GIF8":
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return abs(w), abs(h)
    if head[:2] in (b"II", b"MM"):
        return _tiff_size(f, head)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return _webp_size(head)
    if head[4:8] == b"ftyp":
        return _heif_size(f)
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while True:  # JPEG segments up to the frame header
        f.seek(at)
        mark = f.read(9)
        if len(mark) < 9 or mark[0] != 0xFF:
            return None
        if 0xC0 <= mark[1] <= 0xCF and mark[1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", mark[5:9])
            return w, h
        at += 2 if mark[1] in (0x01, 0xFF) or 0xD0 <= mark[1] <= 0xD8 else 2 + struct.unpack(">H", mark[2:4])[0]


def _tiff_size(f, head: bytes) -> tuple[int, int] | None:
    """The largest page: the directories are followed one by one, entries only."""
    order = "<" if head[:2] == b"II" else ">"
    kind = struct.unpack(order + "H", head[2:4])[0]
    if kind not in (42, 43):
        return None
    # (offset and count format, entry length, value position) of plain and of 64-bit files
    at_fmt, n_fmt, length, value = ("I", "H", 12, 8) if kind == 42 else ("Q", "Q", 20, 12)
    at = struct.unpack(order + at_fmt, head[4:8] if kind == 42 else head[8:16])[0]
    best, seen = None, set()
    while at and at not in seen and len(seen) < MAX_PAGES:
        seen.add(at)
        f.seek(at)
        n = struct.unpack(order + n_fmt, _exactly(f, struct.calcsize(n_fmt)))[0]
        if n > MAX_ENTRIES:
            return best
        page = {}
        for _ in range(n):
            entry = _exactly(f, length)
            tag, type_ = struct.unpack(order + "HH", entry[:4])
            if tag in (256, 257) and type_ in (3, 4, 16):  # image width and length, as 16, 32 or 64 bits
                fmt = {3: "H", 4: "I", 16: "Q"}[type_]
                page[tag] = struct.unpack(order + fmt, entry[value : value + struct.calcsize(fmt)])[0]
        if len(page) == 2 and (best is None or page[256] * page[257] > best[0] * best[1]):
            best = page[256], page[257]
        at = struct.unpack(order + at_fmt, _exactly(f, struct.calcsize(at_fmt)))[0]
    return best


def _webp_size(head: bytes) -> tuple[int, int] | None:
    kind = head[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
    if kind == b"VP8L" and head[20] == 0x2F:
        bits = int.from_bytes(head[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and head[23:26] == b"\x9d\x01\x2a":
        w, h = struct.unpack("<HH", head[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def _boxes(f, at: int, end: int | None):
    """(kind, content start, end) of the boxes between two positions; only their headers are read."""
    while end is None or at + 8 <= end:
        f.seek(at)
        head = f.read(16)
        if len(head) < 8:
            return
        size, kind, start = struct.unpack(">I", head[:4])[0], head[4:8], at + 8
        if size == 1 and len(head) == 16:
            size, start = struct.unpack(">Q", head[8:16])[0], at + 16
        stop = (1 << 62 if end is None else end) if size == 0 else at + size
        if stop < start or (end is not None and stop > end):
            return
        yield kind, start, stop
        at = stop


def _heif_size(f) -> tuple[int, int] | None:
    """The largest extent among the item properties (tiles are smaller than the grid they make up)."""
    best = None

    def look(at: int, end: int | None, path: tuple[bytes, ...]) -> None:
        nonlocal best
        for kind, start, stop in _boxes(f, at, end):
            if path and kind == path[0]:
                look(start + (4 if kind == b"meta" else 0), stop, path[1:])
                if kind == b"meta":
                    return
            elif not path and kind == b"ispe":
                f.seek(start + 4)
                w, h = struct.unpack(">II", _exactly(f, 8))
                if best is None or w * h > best[0] * best[1]:
                    best = w, h

    look(0, None, (b"meta", b"iprp", b"ipco"))
    return best


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise struct.error("header ends early")
    return data


def _link_images(folder: str, limit: int):
    """mapInArrow: (path) -> (path, name of its link below ``folder``; NULL: too large or unreadable)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            paths, names = batch.column("path").to_pylist(), []
            for p in paths:
                try:
                    size = header_size(p)
                    if size is not None and size[0] * size[1] > 2 * limit:
                        names.append(None)
                        continue
                    name = hashlib.blake2b(p.encode("utf-8", "surrogateescape"), digest_size=16).hexdigest() + ".img"
                    if is_remote(folder) or is_remote(p):
                        copy_file(p, f"{folder}/{name[:2]}/{name}")
                    else:
                        os.makedirs(f"{folder}/{name[:2]}", exist_ok=True)
                        if not os.path.lexists(f"{folder}/{name[:2]}/{name}"):
                            os.symlink(mounted(p), f"{folder}/{name[:2]}/{name}")
                    names.append(name)
                except FileExistsError:  # another attempt of this task made it
                    names.append(name)
                except OSError:
                    names.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(names, pa.string())], names=["path", "name"])

    return run


def phash_provider(spark: SparkSession, max_image_pixels: int | None = None):
    """Fingerprint provider for the classifier: pHash of exactly the given paths, NULL where there is none."""
    limit = DEFAULT_MAX_IMAGE_PIXELS if max_image_pixels is None else max_image_pixels

    def provide(df: DataFrame) -> DataFrame:
        base = scratch_folder(spark, "images")
        folder = qualified(spark, f"{base}/links")
        folder = folder if is_remote(folder) else mounted(folder)
        spark.createDataFrame([], "path string").write.parquet(f"{base}/links/none")  # the folder exists without images too
        df.select("path").mapInArrow(_link_images(folder, limit), "path string, name string").write.parquet(f"{base}/names")
        names = spark.read.parquet(f"{base}/names")
        imgs = (
            spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.img").load(f"{base}/links")
            .select(F.regexp_extract("image.origin", "[^/]+$", 0).alias("name"), "image")
        )
        ok = within_pixel_limit("image.width", "image.height", limit) & (F.col("image.height") > 0)
        fps = imgs.select("name", F.when(ok, image_phash(F.when(ok, F.col("image")))).alias("fp"))
        return names.join(fps, "name", "left").select("path", "fp")

    provide.__name__ = f"image_phash(max_pixels={max_image_pixels})"
    return provide


def image_fingerprints(spark: SparkSession, root: str, max_image_pixels: int | None = None, extensions=None) -> DataFrame:
    """(path, fp) for every image file (by extension) of the tree ``root``."""
    from .filetree import scan_tree

    exts = image_extensions(extensions)
    files = scan_tree(spark, root).filter(is_image("ext") & F.col("ext").isin(*exts))
    return phash_provider(spark, max_image_pixels)(files)


# --- PNG encoding (used to derive image files from table data) --------------

def png_bytes(grey: np.ndarray) -> bytes:
    """8-bit greyscale PNG (signature, IHDR, IDAT, IEND)."""
    h, w = grey.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body) & 0xFFFFFFFF)

    raw = b"".join(b"\x00" + grey[y].astype(np.uint8).tobytes() for y in range(h))
    ihdr = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", ihdr) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_vector_images(vectors: DataFrame, out_dir: str, key: str = "vec_id", vec: str = "embedding", side: int = 8, scale: int = 8) -> DataFrame:
    """Render each vector as a ``side x side`` greyscale image (min-max scaled,
    upscaled ``scale`` times) and write ``<out_dir>/<key>.png`` from the executors.
    Returns (key, path) of the written files.  Every vector must have ``side * side`` elements."""
    out_dir = mounted(out_dir)

    def run(batches):
        os.makedirs(out_dir, exist_ok=True)
        for pdf in batches:
            paths = []
            for k, v in zip(pdf[key], pdf[vec]):
                a = np.asarray(v, dtype=np.float64)
                if len(a) != side * side:
                    raise ValueError(f"{key} {k}: {len(a)} elements, not {side * side}")
                lo, hi = a.min(), a.max()
                g = np.zeros_like(a) if hi <= lo else np.round((a - lo) / (hi - lo) * 255)
                img = np.kron(g.reshape(side, side), np.ones((scale, scale)))
                p = os.path.join(out_dir, f"{k}.png")
                with open(p, "wb") as f:
                    f.write(png_bytes(img))
                paths.append(p)
            yield pd.DataFrame({key: pdf[key], "path": paths})

    return vectors.select(key, vec).mapInPandas(run, f"{key} long, path string")
