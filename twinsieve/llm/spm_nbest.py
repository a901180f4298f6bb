"""SentencePiece encoding with N-best segmentations, and decoding.

The lattice of a text has a node at every character border and an edge for every
vocabulary piece that matches; a character that no piece covers alone gets one
edge of its byte pieces (at a score below every piece's).  A path's score is the sum of its pieces'
scores.  Forward Viterbi gives every node the score of the best path to it: an exact
heuristic, so that an A-star search from the end backwards pops complete paths in
order of score - the N best.

No piece crosses the border before a white-space mark that follows another
character, so every path passes there and the lattice falls into chunks (words).
Chunks recur, so each worker remembers their best path and how much the
second-best costs; those of new chunks are found for many at once, position by position, in
numpy.  The N best of a text differ from the best only in the N - 1 chunks
whose second-best costs least, and only those are searched.  Texts are never cut:
the result is the N best of the whole lattice.

The vocabulary file is a byte-pair model: its scores (minus the merge rank) are taken as the
piece scores of the lattice, so the best path is the path of the largest sum, not the
merge order's result.

Defined results: null text is empty: one segmentation without pieces and score 0; a text with
fewer than N segmentations has that many rows; ties keep a fixed order; null ids and
repeated rows pass through row by row; other columns are ignored; decoding gives the normalised text (a
literal U+2581 comes back as a space).
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from twinsieve.llm.common import Memo, by_position, word_borders

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Added to the least piece score for a character that only bytes can spell.
UNKNOWN_PENALTY = 10.0
#: Scores below this mark pieces that are matched by rule, not ranked.
UNRANKED = -1e8
#: Characters of the longest chunk that is remembered and searched together with others.
LONGEST = 48
#: Characters of the texts that are looked up together (a longer text alone).
TOGETHER = 1 << 21


class PieceTrie:
    """The pieces as a trie in flat arrays: the two best paths of many short texts at once.

    Texts are laid out longest first and position by position, so that all that reach a position lie side by side."""

    #: Characters taken together: bounds the memory.
    BLOCK = 1 << 17

    def __init__(self, piece: dict[str, tuple[float, int]], unknown_score: float):
        #: A character that no piece covers alone gets, as its id, this and its code point.
        self.spelt = max((i for _, i in piece.values()), default=0) + 1
        self.unknown_score = unknown_score
        chars = sorted({c for p in piece for c in p})
        self.kinds, self.kind = len(chars) + 1, np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, self.kinds)
        node = {"": 0}
        for p in piece:
            for k in range(1, len(p) + 1):
                node.setdefault(p[:k], len(node))
        # The last node stands for characters that are in no piece.
        self.score, self.id = np.full(len(node) + 1, -np.inf), np.zeros(len(node) + 1, np.uint32)
        self.inner, self.first = np.zeros(len(node) + 1, bool), np.full(self.kinds, len(node))
        # The child of a node by a character, in a hash table with linear probing.
        self.bits = (4 * len(node)).bit_length()
        self.slot_key, self.slot_node = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        for p, at in node.items():
            if p in piece:
                self.score[at], self.id[at] = piece[p]
            if len(p) == 1:
                self.first[self.kind[ord(p)]] = at
        longer = [(node[p[:-1]], ord(p[-1]), at) for p, at in node.items() if len(p) > 1]
        if longer:
            up, char, down = np.array(longer).T
            self.inner[up] = True
            key = up * self.kinds + self.kind[char]
            for k, at, slot in zip(key.tolist(), down.tolist(), self._slot(key).tolist()):
                while self.slot_key[slot] >= 0:
                    slot = (slot + 1) % len(self.slot_key)
                self.slot_key[slot], self.slot_node[slot] = k, at

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def child(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The nodes that ``kind`` leads to from ``node``; -1 where there is none."""
        key = node * self.kinds + kind
        slot = self._slot(key)
        there = self.slot_key[slot]
        out = np.where(there == key, self.slot_node[slot], -1)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.slot_key)
            there = self.slot_key[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.slot_node[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def two_best(self, texts: list[str]) -> list[tuple[np.ndarray, ...]]:
        """In blocks, of non-empty texts: their places in ``texts``, the ids of the best paths in one array, the ends of each
        one's ids there, the best path's score, what the second-best costs against it."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")
        total = np.cumsum(size[order])
        cuts = np.flatnonzero(np.diff(total // self.BLOCK)) + 1
        return [(block, *self._block([texts[i] for i in block.tolist()], size[block])) for block in np.split(order, cuts) if len(block)]

    def _block(self, texts: list[str], size: np.ndarray):
        n, longest = len(texts), int(size[0])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        begin = np.cumsum(size) - size
        reach = np.searchsorted(-size, -np.arange(1, longest + 2), side="right")  # [j]: texts longer than j
        off = np.concatenate([[0], np.cumsum(reach)])
        points = points[np.concatenate([begin[: reach[j]] + j for j in range(longest)])]
        kind = self.kind[points]
        width = np.repeat(reach[:longest], reach[:longest])
        more = np.concatenate([size[: reach[j]] > j + 1 for j in range(longest)])
        # Edges by their length: score (-inf where there is none) and id, at the place where they start.
        edge, ids = [], []
        start = at = np.arange(len(kind))
        node = self.first[kind]
        while len(start):
            e, x = np.full(len(kind), -np.inf), np.zeros(len(kind), np.uint32)
            e[start], x[start] = self.score[node], self.id[node]
            if not edge:
                bare = np.flatnonzero(e == -np.inf)
                e[bare], x[bare] = self.unknown_score, self.spelt + points[bare]
            edge.append(e)
            ids.append(x)
            go = np.flatnonzero(more[at] & self.inner[node])
            start, at, node = start[go], at[go], node[go]
            at = at + width[at]
            node = self.child(node, kind[at])
            go = np.flatnonzero(node >= 0)
            start, at, node = start[go], at[go], node[go]
        best, second, back = [np.zeros(n)], [np.full(n, -np.inf)], np.zeros(len(kind), np.int64)
        score, cost = np.empty(n), np.empty(n)
        for j in range(1, longest + 1):
            m = reach[j - 1]
            b, s, k = np.full(m, -np.inf), np.full(m, -np.inf), back[off[j - 1] : off[j]]
            for length in range(min(j, len(edge)), 0, -1):  # of equal scores the longer last piece goes first
                i = j - length
                e = edge[length - 1][off[i] : off[i] + m]
                v = best[i][:m] + e
                np.maximum(s, np.minimum(b, v), out=s)
                np.maximum(s, second[i][:m] + e, out=s)
                k[v > b] = length
                np.maximum(b, v, out=b)
            best.append(b)
            second.append(s)
            ended = slice(reach[j], m)
            score[ended], cost[ended] = b[ended], b[ended] - s[ended]
        # All paths back at once, a piece a round.
        ids, steps, text, end = np.concatenate(ids), [], np.arange(n), size.copy()
        pieces = np.zeros(n, np.int64)
        while len(text):
            length = back[off[end - 1] + text]
            end = end - length
            steps.append((text, ids[(length - 1) * len(kind) + off[end] + text]))
            pieces[text] += 1
            go = np.flatnonzero(end)
            text, end = text[go], end[go]
        ends = np.cumsum(pieces)
        path = np.empty(ends[-1], np.uint32)
        for k, (text, x) in enumerate(steps, 1):
            path[ends[text] - k] = x
        return path, ends, score, cost


class Chunks:
    """The chunks of some texts: the distinct ones with their best paths, and by place which one stands there."""

    def __init__(self, lists, lat: PieceLattice, known: Memo, mark: str):
        """``lists``: an Arrow array with the chunks of every text, without their ``mark``."""
        each = lists.flatten().dictionary_encode()
        self.mark, self.distinct = mark, each.dictionary.to_pylist()
        self.which = each.indices.to_numpy()
        self.bounds = np.cumsum([0, *lists.value_lengths().to_pylist()]).tolist()
        found = known.many(self.distinct, lat.entries(mark))
        self.ids, self.spelled = [x[0] for x in found], [x[3] for x in found]
        self.score, self.cost = (np.fromiter((x[k] for x in found), np.float64, len(found))[self.which] for k in (1, 2))
        size = np.fromiter(map(len, self.ids), np.int64, len(self.ids))[self.which]
        self.end = np.cumsum(size)
        self.start = self.end - size


class Ranked:
    """The ``n`` best segmentations of a text: ``ranked`` holds (score, {chunk: (other ids, what they spell)}), best first."""

    def __init__(self, own: Chunks, k: int, lat: PieceLattice, n: int):
        a, b = own.bounds[k], own.bounds[k + 1]
        self.own, self.at = own, a
        self.which = own.which[a:b].tolist()
        self.ranked = [(0.0, {})]
        if n > 1:
            cost = own.cost[a:b]
            pick = np.arange(b - a)
            if b - a > 4 * n:
                pick = np.flatnonzero(cost <= np.partition(cost, n - 2)[n - 2])
            pick = pick[np.argsort(cost[pick], kind="stable")][: n - 1]
            for c in sorted(pick[cost[pick] < np.inf].tolist()):
                options = lat.options(n)[self.chunk(c)]
                self.ranked = sorted(((x + d, {**m, c: o}) for x, m in self.ranked for d, o in options), key=lambda x: -x[0])[:n]
        total = sum(own.score[a:b].tolist())
        self.ranked = [(total + d, m) for d, m in self.ranked] if self.which else [(0, {})]

    def chunk(self, c: int) -> str:
        return self.own.mark + self.own.distinct[self.which[c]]

    def ids(self) -> list[bytes]:
        """By rank."""
        best = b"".join(map(self.own.ids.__getitem__, self.which))
        out, base = [], int(self.own.start[self.at]) if self.which else 0
        for _, other in self.ranked:
            parts, done = [], 0
            for c in sorted(other):
                parts += best[done : int(self.own.start[self.at + c]) - base], other[c][0]
                done = int(self.own.end[self.at + c]) - base
            out.append(b"".join([*parts, best[done:]]) if other else best)
        return out

    def decoded(self) -> list[bytes]:
        """By rank, the text that the pieces spell; the same object where it is the same."""
        parts = list(map(self.own.spelled.__getitem__, self.which))
        best = b"".join(parts).removeprefix(b" ")
        out = []
        for _, other in self.ranked:
            changed = {c: x for c, (_, x) in other.items() if x != parts[c]}
            out.append(b"".join(changed.get(c, x) for c, x in enumerate(parts)).removeprefix(b" ") if changed else best)
        return out


class PieceLattice:
    def __init__(self, path: str | None = None, memo_size: int = 300_000):
        import ahocorasick
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.piece: dict[str, tuple[float, int]] = {}
        self.spell: list[bytes] = []
        self.byte = {}
        for i in range(n):
            p = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                self.spell.append(bytes([int(p[1:-1], 16)]))
            elif self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i):
                self.spell.append(b"")
            else:
                self.piece[p] = (float(self.sp.get_score(i)), i)
                self.spell.append(p.replace(SPACE, " ").encode())
        self.unknown = self.sp.unk_id()
        self.unknown_score = min((s for s, _ in self.piece.values() if s > UNRANKED), default=0.0) - UNKNOWN_PENALTY
        #: Pieces and, with None, the beginnings of longer pieces: a miss ends the extension of a match.
        self.table = dict.fromkeys((p[:k] for p in self.piece for k in range(1, len(p))), None) | self.piece
        self.alone = {p for p in self.piece if len(p) == 1}
        self.matcher = ahocorasick.Automaton()
        for p, (score, i) in self.piece.items():
            self.matcher.add_word(p, (len(p), score, i))
        self.matcher.make_automaton()
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.piece)
        self.parts = word_borders(self.piece, SPACE)
        self.trie = PieceTrie(self.piece, self.unknown_score)
        self.spell_size = np.array([len(x) for x in self.spell])
        self.part = Memo(self.summary, memo_size)
        #: By what stands before every key.
        self.known = {mark: Memo(lambda s, mark=mark: self.chunk_summary(mark + s), memo_size) for mark in ("", SPACE)}
        self.memo_size, self.searched = memo_size, {}
        #: The normaliser only marks white space: words can be told apart in the text itself.
        self.verbatim = self.splits and self.sp.normalize("a  b\ncﬁ ") == "▁a▁▁b\ncﬁ▁"

    def _unknown(self, char: str) -> tuple[float, tuple[int, ...]]:
        """Score and ids of a character that no piece covers alone."""
        return self.unknown_score, tuple(self.byte[b] for b in char.encode()) if len(self.byte) == 256 else (self.unknown,)

    def edges(self, s: str) -> list[list[tuple[int, float, object]]]:
        """By start, the edges (end, score, id or ids) of the lattice of ``s``."""
        table, n, out = self.table, len(s), []
        for i in range(n):
            hit = table.get(s[i])
            if hit:
                own = [(i + 1, *hit)]
            else:
                own = [(i + 1, *self._unknown(s[i]))]
            for j in range(i + 2, n + 1):
                hit = table.get(s[i:j], False)
                if hit:
                    own.append((j, *hit))
                elif hit is False:
                    break
            out.append(own)
        return out

    @staticmethod
    def _flat(path) -> list[int]:
        out = []
        for x in path:
            out.extend(x) if isinstance(x, tuple) else out.append(x)
        return out

    def n_best(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of ``s`` by backward A-star: (score, ids), best first."""
        into: list[list] = [[] for _ in range(len(s) + 1)]
        for end, (length, score, ids) in self.matcher.iter(s):
            into[end + 1].append((end + 1 - length, score, ids))
        for i, c in enumerate(s):
            if c not in self.alone:
                into[i + 1].append((i, *self._unknown(c)))
        best = [0.0]
        for own in into[1:]:
            best.append(max([best[i] + sc for i, sc, _ in own]))
        heap, tick, out = [(-best[len(s)], 0, len(s), 0.0, None)], 0, []
        while heap and len(out) < n:
            f, _, at, behind, path = heapq.heappop(heap)
            if not at:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((-f, self._flat(ids)))
                continue
            for i, sc, ids in into[at]:
                tick -= 1  # of equal scores the path found last goes on first
                heapq.heappush(heap, (-(best[i] + sc + behind), tick, i, behind + sc, (ids, path)))
        return out

    def entries(self, mark: str):
        """Gives the :meth:`chunk_summary` of many keys of ``known[mark]``: short ones together."""

        def compute(keys: list[str]) -> list[tuple[bytes, float, float, bytes]]:
            chunks, first = [mark + k for k in keys], self.trie.spelt
            many = [i for i, s in enumerate(chunks) if 0 < len(s) <= LONGEST]
            out: list = [None] * len(keys)
            for block, path, ends, score, cost in self.trie.two_best([chunks[i] for i in many]):
                bare = np.flatnonzero(path >= first)
                if len(bare):  # characters spelt by bytes: their ids take the place of the mark
                    own = [self._unknown(chr(x))[1] for x in (path[bare] - first).tolist()]
                    more = np.array([len(x) for x in own])
                    times = np.ones(len(path), np.int64)
                    times[bare] = more
                    path = np.repeat(path, times)
                    after = np.cumsum(times)
                    at = np.repeat(after[bare] - np.cumsum(more), more) + np.arange(more.sum())
                    path[at] = list(chain.from_iterable(own))
                    ends = after[ends - 1]
                ids, letters = path.astype(self.dtype).tobytes(), b"".join(map(self.spell.__getitem__, path.tolist()))
                last = np.concatenate([[0], np.cumsum(self.spell_size[path])])[ends].tolist()
                ends, a, x = (ends * self.dtype.itemsize).tolist(), 0, 0
                for i, b, y, sc, co in zip(block.tolist(), ends, last, score.tolist(), cost.tolist()):
                    out[many[i]] = (ids[a:b], sc, co, letters[x:y])
                    a, x = b, y
            return [self.chunk_summary(s) if got is None else got for s, got in zip(chunks, out)]

        return compute

    def chunk_summary(self, s: str) -> tuple[bytes, float, float, bytes]:
        """:meth:`summary` of a chunk, put together from parts that no piece crosses (words recur without their punctuation)."""
        parts = self.parts.findall(s) if self.splits else [s]
        if len(parts) == 1:
            return self.part[s]
        ids, score, cost, spelled = zip(*map(self.part.__getitem__, parts))
        return b"".join(ids), sum(score), min(cost), b"".join(spelled)

    def summary(self, s: str) -> tuple[bytes, float, float, bytes]:
        """(ids of the best path, its score, what the second-best path costs against it, what the ids spell)."""
        n = at = len(s)
        plain = self.alone.issuperset(s)
        edges = self.matcher.iter(s)  # every piece that matches anywhere, by its end
        if not plain:
            edges = sorted([*edges, *((i, (1, *self._unknown(c))) for i, c in enumerate(s) if c not in self.alone)], key=lambda x: x[0])
        # The two best scores of the paths to every node, and the edge that the best one comes by.
        best, second, back = [-1e300] * (n + 1), [-np.inf] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for j, edge in edges:
            j += 1
            i = j - edge[0]
            v = best[i] + edge[1]
            if v > best[j]:
                w = second[i] + edge[1]
                if back[j] is not None and best[j] > w:
                    w = best[j]
                if w > second[j]:
                    second[j] = w
                best[j] = v
                back[j] = edge
            elif v > second[j]:
                second[j] = v
        path = []
        while at:
            edge = back[at]
            path.append(edge[2])
            at -= edge[0]
        path.reverse()
        ids = array(self.code, path if plain else self._flat(path)).tobytes()
        return ids, best[n], best[n] - second[n], self.spelled(ids)

    def chunks(self, text: str) -> list[str]:
        s = self.sp.normalize(text)
        if not s:
            return []
        if not self.splits:
            return [s]
        if SPACE * 2 in s or s[0] != SPACE or s[-1] == SPACE:
            return CHUNK.findall(s)
        return [SPACE + w for w in s.split(SPACE)[1:]]

    def segmentations(self, text: str, n: int) -> tuple[list[bytes], list[tuple[float, dict[int, tuple[bytes, int]]]], list[str]]:
        """(ids of every chunk's best path, the ``n`` best as (score, {chunk: other ids}), chunks)."""
        (got,) = self.ranked([text], n)
        ranked = [(s, {c: ids for c, (ids, _) in other.items()}) for s, other in got.ranked]
        return [got.own.ids[i] for i in got.which], ranked, [got.chunk(c) for c in range(len(got.which))]

    def ranked(self, texts: list[str], n: int) -> list[Ranked]:
        """The ``n`` best segmentations of every text; a chunk that recurs in them is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        groups: dict[str, list] = {SPACE: [], "": []}
        places = []
        for text in texts:
            if self.verbatim and text and not ("  " in text or SPACE in text or text[0] == " " or text[-1] == " "):
                mark, own = SPACE, text
            else:
                mark, own = "", self.chunks(text)
            places.append((mark, len(groups[mark])))
            groups[mark].append(own)
        lists = {SPACE: pc.split_pattern(pa.array(groups[SPACE], pa.large_string()), " "), "": pa.array(groups[""], pa.large_list(pa.large_string()))}
        own = {mark: Chunks(x, self, self.known[mark], mark) for mark, x in lists.items() if len(x)}
        return [Ranked(own[mark], k, self, n) for mark, k in places]

    def options(self, n: int) -> Memo:
        """By chunk, its ``n`` best paths: what each costs (negative), its ids and what they spell."""
        if n not in self.searched:

            def search(s: str):
                found = self.n_best(s, n)
                ids = [np.array(x, dtype=self.dtype).tobytes() for _, x in found]
                return [(score - found[0][0], (x, self.spelled(x))) for (score, _), x in zip(found, ids)]

            self.searched[n] = Memo(search, self.memo_size // 10)
        return self.searched[n]

    def spelled(self, ids: bytes) -> bytes:
        return b"".join(map(self.spell.__getitem__, np.frombuffer(ids, dtype=self.dtype).tolist()))

    def decode_bytes(self, ids) -> bytes:
        out = b"".join(map(self.spell.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out


_LOADED: dict = {}


def lattice(path: str | None = None) -> PieceLattice:
    if path not in _LOADED:
        _LOADED[path] = PieceLattice(path)
    return _LOADED[path]


def encode(docs: DataFrame, n: int = 4, model: str | None = None, digest: bool = False) -> DataFrame:
    """(doc_id, rank, score, n_pieces, ids): the ``n`` best segmentations of every text.

    ``digest`` gives ``ids_crc32`` (of the ids as little-endian unsigned 32-bit) and ``decoded_sha256`` (of the
    text decoded from them) instead of ``ids``."""

    def run(batches):
        import pyarrow as pa

        lat = lattice(model)
        for batch in batches:
            texts, chars, at = [], 0, 0
            for i, t in enumerate(batch.column("text"), 1):
                texts.append(t.as_py() or "")
                chars += len(texts[-1])
                if i < batch.num_rows and len(texts) < 4096 and chars < TOGETHER:
                    continue
                row, rank, score, count, last, shas = [], [], [], [], [], []
                for k, got in enumerate(lat.ranked(texts, n), at):
                    row += [k] * len(got.ranked)
                    rank += range(1, len(got.ranked) + 1)
                    score += [s for s, _ in got.ranked]
                    paths = [np.frombuffer(x, dtype=lat.dtype) for x in got.ids()]
                    count += map(len, paths)
                    if digest:
                        last += [zlib.crc32(x.astype("<u4")) for x in paths]
                        before = sha = None
                        for x in got.decoded():
                            if x is not before:
                                before, sha = x, hashlib.sha256(x).hexdigest()
                            shas.append(sha)
                    else:
                        last += [x.astype(np.int32) for x in paths]
                columns = {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "rank": pa.array(rank, pa.int32()),
                           "score": pa.array(score, pa.float64()), "n_pieces": pa.array(count, pa.int64())}
                if digest:
                    columns |= {"ids_crc32": pa.array(last, pa.int64()), "decoded_sha256": pa.array(shas, pa.string())}
                else:
                    columns["ids"] = pa.array(last, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)
                texts, chars, at = [], 0, i

    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = "ids_crc32 long, decoded_sha256 string" if digest else "ids array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, rank int, score double, n_pieces long, {tail}")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The rows of ``encoded`` with ``text``, decoded from their ``ids`` (null ids: null; invalid bytes are replaced)."""
    at = encoded.columns.index("ids")
    keep = [(i, c) for i, c in enumerate(encoded.columns) if c != "text"]

    def run(batches):
        import pyarrow as pa

        lat = lattice(model)
        for batch in batches:
            texts = [None if x is None else lat.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, _ in keep), pa.array(texts, pa.string())], names=[*(c for _, c in keep), "text"])

    kinds = ", ".join(f"`{c}` {encoded.schema[i].dataType.simpleString()}" for i, c in keep)
    return by_position(encoded).mapInArrow(run, f"{kinds}, text string")
