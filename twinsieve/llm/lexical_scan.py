"""Ranked lexical search by an Aho-Corasick scan of the documents, without a document index.

The terms of all items form one automaton.  Every term stands in it between two
boundary marks, and a text is scanned as its bytes with A-Z lower-cased and every
separator replaced by the mark: an output of the automaton is a whole term, never part
of a longer one, and neighbouring terms share the mark between them.  One pass over
the texts gives each document's terms ``n`` and, by term, its occurrences ``tf``;
Spark sums these into N, L and every ``df``.  The outputs then map to items: each
task adds a document's term scores up by item in 64-bit integers and keeps the best
``top`` documents of every item it has seen, and a window takes the best of all tasks.

Bounds: the items are dealt into blocks of at most ``block_bytes`` of terms (a block holds
one item at least, whose text is one row anyway), and only a block's automaton, weights and
term-to-item lists are broadcast; each further block is another scan of all documents.
No row is emitted for a pair of document and item: a task returns at most ``top`` rows an item.

Defined results: null text has no term, as an empty one, and such documents are not
counted in N; an item without terms, or whose terms occur nowhere, has no row; of equal
scores the smaller ``doc_id`` goes first, a null one last; every document row and every item
row counts for itself, repeated ones too (an item given twice has its rows twice); a very
long text is one scan; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.common import Scratch, ascii_lower

#: Terms: maximal runs of ASCII letters, digits and everything beyond ASCII.
TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: By byte: term bytes lower-cased, separators as the boundary mark (a space).
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_BYTES = 32 << 20
#: What a term costs a block beside its bytes: its place in the automaton and the lists.
TERM_BYTES = 64
#: Cells (documents x items) and additions that a scoring step holds at a time.
CELLS = 1 << 22


def folded(text: str | None) -> bytes:
    return (text or "").encode().translate(FOLD)


def automaton(terms: list[str]):
    """The boundary-guarded automaton of ``terms``; a term's output is its position."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(f" {t} ".encode().decode("latin-1"), i)
    out.make_automaton()
    return out


def count_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's terms in all, and those of ``terms`` that it holds with their occurrences."""
    guarded = docs.sparkSession.sparkContext.broadcast(automaton(terms) if terms else None)

    def scan(batches):
        import pyarrow as pa

        found, term_of = guarded.value, itemgetter(1)
        for batch in batches:
            n, which, tfs, ends = [], [], [], [0]
            for text in batch.column("text"):
                raw = folded(text.as_py())
                n.append(len(raw.split()))
                if found is not None and n[-1]:
                    tf = Counter(map(term_of, found.iter(f" {raw.decode('latin-1')} ")))
                    which.extend(tf.keys())
                    tfs.extend(tf.values())
                ends.append(len(which))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(which, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The ``top`` documents of each item so far, as rows (item, score, doc) in that order of rank."""

    def __init__(self, items: int, top: int):
        self.top, self.rows, self.least = top, None, np.ones(items, dtype=np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, doc) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        new = pa.table({"item": pa.array(item, pa.int32()), "score": pa.array(score, pa.int64()), "doc": doc})
        rows = new if self.rows is None else pa.concat_tables([self.rows, new])
        order = pc.sort_indices(rows, sort_keys=[("item", "ascending"), ("score", "descending"), ("doc", "ascending")], null_placement="at_end")
        rows = rows.take(order).combine_chunks()
        item = rows["item"].to_numpy()
        first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        self.rows = rows.filter(pa.array(place < self.top))
        full = place == self.top - 1
        self.least[item[full]] = rows["score"].to_numpy()[full]


def best_documents(counts: DataFrame, postings: dict[str, np.ndarray], items: int, documents: int, total: int, top: int) -> DataFrame:
    """(item, doc_id, score): each task's ``top`` documents of every item.

    ``postings``: weight ``w`` by term, and by term (``ends``) its ``item`` and ``repeats``."""
    shared = counts.sparkSession.sparkContext.broadcast(postings)

    def score(batches):
        import pyarrow as pa

        p = shared.value
        w, ends, item_of, repeats = p["w"], p["ends"], p["item"], p["repeats"]
        fan = np.diff(ends)
        best = Best(items, top)
        for batch in batches:
            n, docs = batch.column("n").to_pylist(), batch.column("doc_id")
            m = np.array([25 + 75 * k * documents // total if total else 25 for k in n], dtype=np.int64)
            lists = batch.column("terms")
            term, tf = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            row = np.repeat(np.arange(len(m)), lists.value_lengths().to_numpy())
            value = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
            adds = np.append(0, np.cumsum(np.bincount(row, weights=fan[term], minlength=len(m)).astype(np.int64)))
            entry = np.append(0, np.cumsum(np.bincount(row, minlength=len(m))))
            at = 0
            while at < len(m):  # as many documents at a time as the bounds allow, one at least
                to = max(at + 1, min(at + max(1, CELLS // max(1, items)), int(np.searchsorted(adds, adds[at] + CELLS, side="right")) - 1))
                e = slice(entry[at], entry[to])
                t, k = term[e], fan[term[e]]
                source = np.repeat(np.arange(len(t)), k)
                place = np.arange(len(source)) - np.repeat(np.cumsum(k) - k, k) + ends[t][source]
                cells = np.zeros((to - at) * items, dtype=np.int64)
                np.add.at(cells, (row[e][source] - at) * items + item_of[place], value[e][source] * repeats[place])
                cells = cells.reshape(to - at, items)
                floor = best.least
                if len(cells) > top:
                    floor = np.maximum(floor, np.partition(cells, len(cells) - top, axis=0)[len(cells) - top])
                r, c = np.nonzero(cells >= floor)
                if len(r):
                    best.offer(c, cells[r, c], docs.take(pa.array(r + at)))
                at = to
        if best.rows is not None:
            for b in best.rows.select(["item", "doc", "score"]).rename_columns(["item", "doc_id", "score"]).to_batches(max_chunksize=10_000):
                yield b

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.mapInArrow(score, f"item int, doc_id {kind}, score long")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_no, item_id, term, repeats) of every item row; ``item_no`` tells repeated rows apart."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    numbered = items.select(F.monotonically_increasing_id().alias("item_no"), "item_id", text.alias("text"))  # numbered before the terms part
    each = numbered.select("item_no", "item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM), 0)).alias("term"))
    return each.groupBy("item_no", "item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def blocks_of(terms: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``terms`` with a ``block``: items dealt out until no block of several items holds over ``block_bytes``."""
    cost = F.octet_length("term") + F.lit(TERM_BYTES)
    size = terms.groupBy("item_no").agg(F.sum(cost).alias("cost"))
    n = max(1, math.ceil((size.agg(F.sum("cost")).first()[0] or 0) / block_bytes))
    while True:
        block = F.pmod(F.xxhash64("item_no"), F.lit(n)).cast("int")
        over = size.groupBy(block.alias("block")).agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("items"))
        if n == 1 or over.where((F.col("cost") > block_bytes) & (F.col("items") > 1)).isEmpty():
            return terms.withColumn("block", block), n
        n *= 2


def rank(docs: DataFrame, items: DataFrame, top: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text)."""
    scratch = Scratch(docs.sparkSession, "lexical")
    terms, n_blocks = blocks_of(scratch.save(item_terms(items.select("item_id", "text")), "items"), block_bytes)
    stats, found = None, []
    for block in range(n_blocks):
        own = terms.where(F.col("block") == block)
        pairs = own.select("item_no", "term", "repeats").toPandas()  # within block_bytes, or one item
        item_no, item = np.unique(pairs["item_no"].to_numpy(), return_inverse=True)
        words, term = np.unique(pairs["term"].to_numpy(dtype=object), return_inverse=True)
        if not len(words):
            continue
        counts = scratch.save(count_terms(docs, words.tolist()), f"counts-{block}")
        if stats is None:
            row = counts.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
            stats = row[0], row[1] or 0
        df = np.zeros(len(words), dtype=np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row a term of the block
            df[r["term"]] = r["count"]
        order = np.argsort(term, kind="stable")
        postings = {
            "w": np.array([weight(stats[0], int(x)) for x in df], dtype=np.int64),
            "ends": np.append(0, np.cumsum(np.bincount(term, minlength=len(words)))),
            "item": item[order].astype(np.int64),
            "repeats": pairs["repeats"].to_numpy(dtype=np.int64)[order],
        }
        best = best_documents(counts, postings, len(item_no), *stats, top)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        ranked = best.withColumn("rank", place).where(F.col("rank") <= top)
        ids = docs.sparkSession.createDataFrame(list(enumerate(item_no.tolist())), "item int, item_no long")
        found.append(ranked.join(ids, "item").select("item_no", "rank", "doc_id", "score"))
    if not found:
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = [docs.sparkSession.createDataFrame([], f"item_no long, rank int, doc_id {kind}, score long")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    names = terms.select("item_no", "item_id").distinct()
    return out.join(names, "item_no").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
