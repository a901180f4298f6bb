"""Fill-in-middle transformation: code-point cuts found in the UTF-8 bytes, eight at a time.

A batch's texts lie in one Arrow buffer.  It is viewed as unsigned 64-bit words: the
bytes that end a code point are those whose next byte is no continuation byte, which
two shifts and two ANDs tell for a whole word.  ``bitwise_count`` gives each word's
units; their running sum places every text's cuts: a binary search finds the word,
a multiplication spreads the running count over its bytes and one comparison selects the
byte.  Texts are cut as bytes there; no code point is decoded, and a text of any length costs one pass.

A document's hash (SHA-256 of ``1:`` and its id) picks its cuts and its form: ``plain``
(the text itself), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).
A text that contains a mark stays plain, so :func:`restore` always finds the marks again.

Defined results: null text is empty, an empty text is plain; a null ``doc_id`` hashes
as the digits of no number (``1:``); repeated rows give equal rows; an empty table no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = "<[PSM]>"
ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
#: Texts taken together: bounds the words and counts held beside the batch.
PIECE_BYTES = 32 << 20


class Units:
    """Rank and select over the code points of one UTF-8 buffer."""

    def __init__(self, raw: np.ndarray):
        self.words = np.zeros(len(raw) // 8 + 2, dtype="<u8")
        self.words.view(np.uint8)[: len(raw)] = raw
        self.words.view(np.uint8)[len(raw) :] = 0x20  # beyond the text: units of their own
        w = self.words
        starts = ~(w & (~w << np.uint64(1))) & HIGH  # no continuation byte: not (bit 7 set and bit 6 clear)
        self.ends = starts >> np.uint64(8)
        self.ends[:-1] |= starts[1:] << np.uint64(56)
        self.before = np.append(np.int64(0), np.cumsum(np.bitwise_count(self.ends), dtype=np.int64))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end before byte ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte after the ``k``-th code point (``k`` from 1)."""
        word = np.searchsorted(self.before, k, side="left") - 1
        running = (self.ends[word] >> np.uint64(7)) * ONES  # by byte: units up to it
        want = (k - self.before[word]).astype(np.uint64) * ONES
        reached = ((running | HIGH) - want) & HIGH
        return word * 8 + 8 - np.bitwise_count(reached).astype(np.int64) + 1


def draws(doc_id) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def transform(docs: DataFrame, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of ``docs`` (doc_id, text).

    Of 100 documents ``100 - plain_from`` stay plain; of 100 others ``spm_below`` take the form spm."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            if not whole.num_rows:
                continue
            text = whole.column("text").fill_null("").cast(pa.large_string())
            marked = pc.match_substring_regex(text, MARK).to_numpy(zero_copy_only=False)
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
                raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[at] : offsets[to]]
                yield piece(whole.column("doc_id").slice(at, to - at), raw, offsets[at : to + 1] - offsets[at], marked[at:to])
                at = to

    def piece(ids, raw, offsets, marked):
        import pyarrow as pa

        units, data = Units(raw), raw.tobytes()
        h = np.array([draws(i) for i in ids.to_pylist()], dtype=np.int64)
        begin, end = offsets[:-1], offsets[1:]
        first = units.rank(begin)
        n = units.rank(end) - first
        cuts = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
        byte = np.where(cuts > 0, units.select(np.maximum(first[:, None] + cuts, 1)), begin[:, None])
        plain = (n == 0) | marked | (h[:, 2] % 100 >= plain_from)
        spm = h[:, 3] % 100 < spm_below
        out = []
        for b, (a, m), e, p, s in zip(begin.tolist(), byte.tolist(), end.tolist(), plain.tolist(), spm.tolist()):
            if p:
                out.append(data[b:e])
            elif s:
                out.append(b"".join((SUFFIX, data[m:e], PREFIX, data[b:a], MIDDLE, data[a:m])))
            else:
                out.append(b"".join((PREFIX, data[b:a], SUFFIX, data[m:e], MIDDLE, data[a:m])))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(cuts[:, 0], pa.int64(), mask=plain),
             pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output and its form came from."""
    part = F.split(output, MARK, -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )
