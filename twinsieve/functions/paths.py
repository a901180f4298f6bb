"""Path scalars: name, suffix/extension, stem, parent, relative and destination paths.

All built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The last dot part of a name, when the dot is not the name's first character
# and is followed by at least one character ('.jpg' has none, 'a.' has none).
SUFFIX_PATTERN = r"^.+(\.[^.]+)$"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def name_of(path: str | Column) -> Column:
    """Last path component."""
    return F.substring_index(_c(path), "/", -1)


def parent_of(path: str | Column) -> Column:
    """Everything before the last '/', '' for a bare name."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def suffix_of(name: str | Column) -> Column:
    """Suffix with original case ('' when there is none)."""
    return F.regexp_extract(_c(name), SUFFIX_PATTERN, 1)


def ext_of(name: str | Column) -> Column:
    """Lower-cased suffix, the key for extension filters and the image test."""
    return F.lower(suffix_of(name))


def stem_of(name: str | Column) -> Column:
    """Name without its suffix (case kept)."""
    n = _c(name)
    return F.substring(n, F.lit(1), F.length(n) - F.length(suffix_of(n)))


def relative_to(path: str | Column, root: str) -> Column:
    """Path relative to ``root`` (both already normalised, no trailing slash on root)."""
    root = root.rstrip("/")
    if not root:
        return _c(path)
    return F.substring(_c(path), len(root) + 2, 1 << 30)


def destination(out_dir: str, rel_path: str | Column) -> Column:
    """Destination path = out dir + relative path."""
    return F.concat_ws("/", F.lit(out_dir.rstrip("/")), _c(rel_path))


def collision_name(stem: str | Column, k: str | Column, suffix: str | Column) -> Column:
    """``{stem}_{k}{suffix}``."""
    return F.concat(_c(stem), F.lit("_"), _c(k).cast("string"), _c(suffix))


def normalise_uri(path: str | Column) -> Column:
    """Strip a ``file:`` scheme and collapse repeated slashes so listings from
    different sources (binaryFile, image, Python data source) join on one key."""
    p = F.regexp_replace(_c(path), r"^file:(//)?", "")
    return F.regexp_replace(p, r"/{2,}", "/")
