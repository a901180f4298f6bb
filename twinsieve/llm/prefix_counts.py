"""Exact token counts at every prefix of a text, by dynamic programming over its positions.

The merges of a byte-pair piece model give every string exactly one segmentation, and whether two
pieces may stand side by side depends on these two alone: merging their concatenation must give
them back.  So the segmentation of a prefix is that of a shorter prefix and one more
piece, and only one piece that ends there fits the last piece of the shorter one:

    last[j] = the piece t = s[i:j] with fits(last[i], t);   count[j] = count[i] + 1

Pieces that end at a position come from an automaton over the vocabulary; ``fits`` is
worked out by merging once a pair and remembered.  The table answers how many tokens any prefix has,
and where a token budget ends, without encoding again.

No piece crosses the border before a white-space mark that follows another character, nor
a character that is in no piece, so texts fall into chunks whose tables are remembered (short ones, in
two generations of bounded size); counts before a chunk are added.  A character that is no piece alone
counts as its bytes (byte fallback) or as one unknown token.

The model's normaliser must keep every code point in place (``identity``): then prefix ``k`` of
the text is prefix ``k + 1`` of its normal form, which starts with a mark.

Defined results: null text is empty and has no tokens; strings of special tokens in a text are ordinary
text; null ids and repeated rows pass through row by row; a very long text, or a very
long word, takes time and memory linear in its length; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import Memo, word_borders

SPACE = "▁"
NEVER = float("-inf")


class Follows(dict):
    """By a piece: may it stand right after ``left``?  Worked out by merging the two, once."""

    __slots__ = ("left", "counter")

    def __init__(self, left: str, counter: PrefixCounter):
        self.left, self.counter = left, counter

    def __missing__(self, right: str) -> bool:
        left, own = self.left, self.counter
        fits = own.merged(left + right) == ([left, right] if left else [right])
        own.pairs += 1
        if own.pairs > own.max_pairs:
            own.forget()
        self[right] = fits
        return fits


class PrefixCounter:
    def __init__(self, path: str | None = None, memo_size: int = 400_000, max_pairs: int = 2_000_000):
        import ahocorasick
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        if sp.normalize("a  b\ncﬁ ") != "▁a▁▁b\ncﬁ▁" or any(map(sp.is_unused, ids)):
            raise ValueError("prefix positions need a model whose normaliser keeps every code point and that uses all pieces")
        self.byte_fallback = sum(map(sp.is_byte, ids)) == 256
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces of this model cross word borders")
        self.alone = {p for p in self.score if len(p) == 1}
        self.pairs, self.max_pairs, self.start = 0, max_pairs, Follows("", self)
        self.matcher = ahocorasick.Automaton()
        self.after = {p: Follows(p, self) for p in self.score}
        for p, after in self.after.items():
            self.matcher.add_word(p, (len(p) - 1, p, after))
        self.matcher.make_automaton()
        self.chunk = word_borders(self.score, SPACE)
        self.table = Memo(lambda s: array("I", self.counts(s)), memo_size)
        self.length = Memo(lambda s: self.counts(s)[-1], memo_size)
        self.word = Memo(lambda w: sum(map(self.length.__getitem__, self.chunk.findall(SPACE + w))), memo_size)

    def forget(self) -> None:
        """Forget what is known of pairs: bounds the memory."""
        self.pairs = 0
        for known in (self.start, *self.after.values()):
            known.clear()

    def merged(self, s: str) -> list[str]:
        """The segmentation of ``s`` as the model defines it: the best-scoring neighbours merge, the leftmost of equal ones first."""
        out, score = list(s), self.score
        gain = [score.get(a + b, NEVER) for a, b in zip(out, out[1:])]
        while gain:
            best = max(gain)
            if best == NEVER:
                break
            i = gain.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del gain[i]
            if i < len(gain):
                gain[i] = score.get(out[i] + out[i + 1], NEVER)
            if i:
                gain[i - 1] = score.get(out[i - 1] + out[i], NEVER)
        return out

    def cost(self, char: str) -> int:
        """Tokens of a character that is no piece."""
        return len(char.encode()) if self.byte_fallback else 1

    def counts(self, s: str) -> list[int]:
        """Token counts of the prefixes 1, 2, ... of a chunk."""
        count, last = [0] * (len(s) + 1), [None] * (len(s) + 1)
        last[0] = self.start
        if self.alone.issuperset(s):  # every position ends a piece
            for end, (k, piece, after) in self.matcher.iter(s):
                if last[end + 1] is None and last[end - k][piece]:
                    last[end + 1] = after
                    count[end + 1] = count[end - k] + 1
        else:
            unknown = [(i, (0, c, Follows(c, self))) for i, c in enumerate(s) if c not in self.alone]
            for end, (k, piece, after) in sorted([*self.matcher.iter(s), *unknown], key=lambda e: e[0]):
                if last[end + 1] is None and last[end - k][piece]:
                    last[end + 1] = after
                    count[end + 1] = count[end - k] + (1 if piece in self.score else self.cost(piece))
        return count[1:]

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text's normal form."""
        return self.chunk.findall(SPACE + text.replace(" ", SPACE))

    def total(self, text: str) -> int:
        """The last entry of the text's table: that of each word in turn where single spaces part them."""
        if not text:
            return 0
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return sum(map(self.length.__getitem__, self.chunks(text)))
        return sum(map(self.word.__getitem__, text.split(" ")))

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text[:len(text)]."""
        if not text:
            return np.zeros(1, dtype=np.int32)
        tables = list(map(self.table.__getitem__, self.chunks(text)))
        before = np.append(0, np.cumsum([t[-1] for t in tables])[:-1])
        out = np.frombuffer(b"".join(t.tobytes() for t in tables), dtype="<u4").astype(np.int32)
        out += np.repeat(before, [len(t) for t in tables]).astype(np.int32)
        out[0] = 0
        return out


_LOADED: dict = {}


def counter(path: str | None = None) -> PrefixCounter:
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def count(docs: DataFrame, model: str | None = None, store: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of ``docs`` (doc_id, text); ``store`` adds ``prefix``: element ``k`` is the count of text[:k]."""

    def run(batches):
        import pyarrow as pa

        own = counter(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n_bytes, n_tokens, tables = [], [], []
                for cell in batch.column("text"):
                    text = cell.as_py() or ""
                    n_bytes.append(len(text.encode()))
                    if store:
                        tables.append(own.prefixes(text))
                        n_tokens.append(int(tables[-1][-1]))
                    else:
                        n_tokens.append(own.total(text))
                columns = {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64())}
                if store:
                    columns["prefix"] = pa.array(tables, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long" + ", prefix array<int>" * store)


def tokens_at(prefix: Column, k) -> Column:
    """Tokens of the first ``k`` code points (null beyond the text), from the stored table."""
    return F.try_element_at(prefix, (F.lit(k) if isinstance(k, int) else k) + 1)


def longest_within(prefix: Column, budget) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from the stored table.

    A longer prefix may have fewer tokens (pieces merge), so the last one that fits counts."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.coalesce(F.array_max(F.transform(prefix, lambda x, i: F.when(x <= limit, i))), F.lit(0))


def truncate(docs: DataFrame, table: DataFrame, budget: int) -> DataFrame:
    """(doc_id, text, n_tokens): the texts cut to their longest prefix of at most ``budget`` tokens; ids must be unique and not null."""
    cut = table.select("doc_id", longest_within(F.col("prefix"), budget).alias("keep"), "prefix").select(
        "doc_id", "keep", tokens_at(F.col("prefix"), F.col("keep")).cast("long").alias("n_tokens"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "text").join(cut, "doc_id").select("doc_id", F.substring(text, F.lit(1), F.col("keep")).alias("text"), "n_tokens")
