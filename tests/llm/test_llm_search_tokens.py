"""Ranked lexical search, prefix token counts and the fill-in-middle transformation against plain computations."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from llm_cases import docs, empty, rows
from twinsieve.llm import fim_swar, lexical_scan, prefix_counts, queries
from twinsieve.llm.common import read

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute_ranks(data, items, top=10):
    held = [(d, terms_of(t)) for d, t in data]
    n_docs, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out = []
    for i, text in items:
        scored = []
        want = terms_of(text)
        for d, t in held:
            tf = Counter(t)
            m = 25 + 75 * len(t) * n_docs // total if total else 25
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m))
                        for x in want if tf[x])
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def ranked(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


ITEMS = [(1, "quick shared TEXT tie"), (2, None), (3, ""), (4, "nowhere"), (5, "é漢🙂 line line other"), (5, "é漢🙂 line line other"),
         (None, "tie short"), (6, "word1 Word699 words the"), (7, " -- ")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300, 1])
def test_ranks_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical_scan, "CELLS", 7)
    items = spark.createDataFrame([(i, t, 3, 4) for i, t in ITEMS], "item_id long, text string, doc_id int, score int")
    data = [(r[0], r[1]) for r in rows()]
    got = ranked(lexical_scan.rank(docs(spark), items, top=4, block_bytes=block_bytes))
    assert got == sorted(brute_ranks(data, ITEMS, 4), key=str)


def test_terms_are_whole_and_neighbours_share_a_mark(spark):
    data = [(1, "a a a aa A-a"), (2, "aa"), (3, "ab a b"), (4, "A"), (5, "x")]
    items = [(1, "a"), (2, "aa ab"), (3, "a b")]
    got = lexical_scan.rank(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert ranked(got) == sorted(brute_ranks(data, items), key=str)


def test_ranks_of_whole_tables(spark):
    data = [(r["doc_id"], r["text"]) for r in read(spark, SF0001, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in read(spark, SF0001, "benchmark").collect()]
    assert ranked(queries.op11_lexical_scan(spark, SF0001)) == sorted(brute_ranks(data, items), key=str)


def test_ranks_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_scan.rank(empty(spark), items).count() == 0
    assert lexical_scan.rank(docs(spark), items.limit(0)).count() == 0
    assert lexical_scan.rank(docs(spark).withColumn("text", F.lit(None).cast("string")), items).count() == 0


# --- prefix counts ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_every_prefix_equals_the_library(library):
    own, rnd = prefix_counts.counter(), random.Random(3)
    letters = " \n\t▁abteinorsTH.,;()'<0x>é漢字🙂\x00\x85"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(800)]
    texts += ["<s></s><unk>", " ", "  ", "▁", "\n\n", "a" * 60 + " b", "    indented    text  ", "www.example.com/a?b=c&d=e;", "......"]
    for t in texts:
        want = [len(library.encode(t[:k])) for k in range(len(t) + 1)]
        assert own.prefixes(t).tolist() == want and own.total(t) == want[-1]


@pytest.mark.parametrize("text", ["ab" * 50_000, " " * 50_001, "漢🙂" * 20_000, "in the " * 20_000 + "end", "x.y,z " * 9_000])
def test_very_long_texts(library, text):
    own = prefix_counts.counter()
    assert own.total(text) == len(library.encode(text)) == own.prefixes(text)[-1]


def test_bounded_memories_change_nothing(library):
    own, texts = prefix_counts.PrefixCounter(memo_size=5, max_pairs=7), ["the end of the other thing, then nothing. more", "a bee or two bees; 3.5"]
    for t in texts * 2:
        assert own.prefixes(t).tolist() == [len(library.encode(t[:k])) for k in range(len(t) + 1)] and len(own.table) <= 5


def test_counts_and_stored_table(spark, library):
    out = prefix_counts.count(docs(spark), store=True)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "prefix"]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], len(r["prefix"])) for r in out.collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), len(library.encode(t or "")), len(t or "") + 1) for d, t, *_ in rows()), key=str)
    assert prefix_counts.count(empty(spark), store=True).count() == 0
    same = sorted(((r["doc_id"], r["n_tokens"]) for r in prefix_counts.count(docs(spark)).collect()), key=str)
    assert same == sorted(((g[0], g[2]) for g in got), key=str)


@pytest.mark.parametrize("budget", [0, 1, 7, 40, 10**9])
def test_budget_and_truncation(spark, library, budget):
    own = read(spark, SF0001, "documents").select("doc_id", F.substring("text", 1, 400).alias("text")).limit(30).cache()
    table = prefix_counts.count(own, store=True)
    texts = {r["doc_id"]: r["text"] or "" for r in own.collect()}
    got = {r["doc_id"]: (r["text"], r["n_tokens"]) for r in prefix_counts.truncate(own, table, budget).collect()}
    for d, t in texts.items():
        keep = max(k for k in range(len(t) + 1) if len(library.encode(t[:k])) <= budget)
        assert got[d] == (t[:keep], len(library.encode(t[:keep])))
    at = {r[0]: r[1] for r in table.select("doc_id", prefix_counts.tokens_at(F.col("prefix"), 9)).collect()}
    assert all(at[d] == (len(library.encode(t[:9])) if len(t) >= 9 else None) for d, t in texts.items())


def test_query_counts_whole_texts(spark, library):
    got = {r["doc_id"]: r for r in queries.op12_prefix_counts(spark, SF0001).collect()}
    for r in read(spark, SF0001, "documents").collect():
        n = len(library.encode(r["text"] or ""))
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["over_limit"]) == (n, len((r["text"] or "").encode()), n > 4096)


# --- fill in the middle ----------------------------------------------------------------------------------------


def brute_fim(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def check_fim(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = fim_swar.transform(df)
    out = out.withColumn("back", fim_swar.restore(F.col("output"), F.col("form")))
    got = sorted([tuple(r) for r in out.collect()], key=str)
    assert got == sorted([(d, *brute_fim(d, t), t or "") for d, t in data], key=str)


def test_fim_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(1)
    letters = "aé漢🙂 \n<PSM>\x00ß"
    data = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))) for i in range(1500)]
    data += [(r[0], r[1]) for r in rows()] + [(2000 + i, "🙂" * i) for i in range(30)] + [(3000, "<S"), (3001, "a<"), (3002, "x<P>y")]
    check_fim(spark, data)
    monkeypatch.setattr(fim_swar, "PIECE_BYTES", 50)
    check_fim(spark, data[:300])
    forms = Counter(brute_fim(d, t)[1] for d, t in data)
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 20


def test_fim_cases(spark):
    assert fim_swar.transform(empty(spark)).count() == 0
    out = fim_swar.transform(docs(spark))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == len(rows())


def test_units_select_inverts_rank():
    import numpy as np

    text = "aé漢🙂 b" * 50
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    units, ends = fim_swar.Units(raw), []
    at = 0
    for c in text:
        at += len(c.encode())
        ends.append(at)
    k = np.arange(1, len(text) + 1)
    assert units.select(k).tolist() == ends and units.rank(np.array(ends)).tolist() == k.tolist()
