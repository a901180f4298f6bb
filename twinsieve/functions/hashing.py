"""Content hashes.

``sha256`` is the native, codegen'd choice (and what the DuckDB oracle can
reproduce).  ``blake2b`` (512-bit, 128 hex chars) is the algorithm of the tool
we mirror; Spark has no built-in for it, so it is an Arrow-batched UDF: one
Python call per batch, ``hashlib`` per value, no pandas conversion.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import HASH_PREFIX_LEN

HASH_ALGOS = ("sha256", "blake2b")


def _blake2b_array(values: pa.Array) -> pa.Array:
    out = []
    for v in values.to_pylist():
        if v is None:
            out.append(None)
        else:
            if isinstance(v, str):
                v = v.encode("utf-8")
            out.append(hashlib.blake2b(v).hexdigest())
    return pa.array(out, type=pa.string())


@F.arrow_udf(T.StringType())
def blake2b_hex(values: pa.Array) -> pa.Array:
    """blake2b-512 hex digest of a string (UTF-8) or binary column; NULL in, NULL out."""
    return _blake2b_array(values)


def content_hash(content: str | Column, algo: str = "sha256") -> Column:
    col = F.col(content) if isinstance(content, str) else content
    if algo == "sha256":
        return F.sha2(col, 256)
    if algo == "blake2b":
        return blake2b_hex(col)
    raise ValueError(f"unknown hash algorithm {algo!r}; choose one of {HASH_ALGOS}")


def hash_prefix(h: str | Column) -> Column:
    """First 16 hex characters, as reported in results."""
    col = F.col(h) if isinstance(h, str) else h
    return F.substring(col, 1, HASH_PREFIX_LEN)
