"""Filters (F1, F2, F4, F5, F8, F9 of the inventory).

All are plain column predicates so Catalyst can push them below any UDF and,
on real scans, into the reader.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import (
    IGNORED_DIR_NAMES,
    IGNORED_FILE_NAMES,
    IGNORED_NAME_PREFIXES,
    IMAGE_EXTENSIONS,
)

# A directory component (followed by '/') equal to one of the ignored names, at any depth.
IGNORED_DIR_PATTERN = "(^|/)(" + "|".join(re.escape(d) for d in IGNORED_DIR_NAMES) + ")/"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_ignored_name(name: str | Column = "name") -> Column:
    """exact ignored names, or an ignored prefix (startswith, not LIKE: '_' is a wildcard there)."""
    n = _c(name)
    cond = n.isin(*IGNORED_FILE_NAMES)
    for p in IGNORED_NAME_PREFIXES:
        cond = cond | F.startswith(n, F.lit(p))
    return cond


def in_ignored_dir(rel_path: str | Column = "rel_path") -> Column:
    """some directory below the root is named like an ignored directory."""
    return _c(rel_path).rlike(IGNORED_DIR_PATTERN)


def drop_ignored(df: DataFrame) -> DataFrame:
    return df.filter(~is_ignored_name("name") & ~in_ignored_dir("rel_path"))


def is_image(ext: str | Column = "ext") -> Column:
    """lower-cased suffix is one of the image extensions."""
    return _c(ext).isin(*IMAGE_EXTENSIONS)


def normalise_extensions(spec: str | Iterable[str] | None) -> tuple[str, ...] | None:
    """Comma list or iterable -> sorted lower-case '.ext' tuple; None/empty means no filter.

    Strips before testing for the leading dot and drops empty items, so
    ``".jpg, .png,"`` gives ``('.jpg', '.png')``.
    """
    if spec is None:
        return None
    items = spec.split(",") if isinstance(spec, str) else list(spec)
    out = set()
    for raw in items:
        e = raw.strip().lower()
        if not e:
            continue
        out.add(e if e.startswith(".") else "." + e)
    return tuple(sorted(out)) or None


def filter_extensions(df: DataFrame, extensions: str | Iterable[str] | None) -> DataFrame:
    """keep rows whose extension is in the user list (applied to both sides)."""
    exts = normalise_extensions(extensions)
    if not exts:
        return df
    return df.filter(F.col("ext").isin(*exts))


def within_pixel_limit(width: str | Column, height: str | Column, max_pixels: int) -> Column:
    """an image fails only above twice the pixel limit (between 1x and 2x it is a warning)."""
    return (_c(width).cast("bigint") * _c(height).cast("bigint")) <= F.lit(2 * int(max_pixels))


def prepare_side(df: DataFrame, extensions=None) -> DataFrame:
    """Scan-side filters in the order the tool applies them: ignored names/dirs, then extensions."""
    return filter_extensions(drop_ignored(df), extensions)
