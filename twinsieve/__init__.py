"""twinsieve - content deduplication between two file collections on Spark.

For every item of a *target* collection, report whether a *reference*
collection already holds it: byte-identical (size-gated content-hash join),
perceptually similar (banded Hamming join over 64-bit fingerprints), or not at
all, in which case the item is selected.
"""

__version__ = "0.1.0"
